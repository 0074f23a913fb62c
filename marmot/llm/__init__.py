"""Operators for large text corpora: de-duplication, search, scoring, extraction, packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
