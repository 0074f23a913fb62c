"""Column-level helpers: every one is a built-in Catalyst expression (codegen, no Python)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Map lookup of a column through a literal map; missing/null keys give ``default``."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(m, col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def action_weight(action: str | Column, vocab: Mapping[str, float], default: float = 1.0) -> Column:
    """Weight of an action; unknown or null actions get ``default`` (case-sensitive)."""
    return lookup(action, {k: float(v) for k, v in vocab.items()}, float(default)).cast("double")


def action_label(action: str | Column, vocab: Mapping[str, float] | None) -> Column:
    """1 when the action is in the vocabulary, else 0; ``vocab=None`` labels every row 1."""
    if vocab is None:
        return F.lit(1).cast("int")
    return F.when(col(action).isin(list(vocab)), 1).otherwise(0).cast("int")


def clip(c: str | Column, lo: int, hi: int) -> Column:
    """Clamp to [lo, hi]; null stays null (``least``/``greatest`` alone would skip the null)."""
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def epoch_ms_to_ts(c: str | Column) -> Column:
    return F.timestamp_millis(col(c))


def ts_micros(c: str | Column) -> Column:
    """Microseconds since epoch of a TIMESTAMP or TIMESTAMP_NTZ column (UTC wall clock)."""
    return F.unix_micros(col(c).cast("timestamp"))


def ts_millis(c: str | Column) -> Column:
    return F.unix_millis(col(c).cast("timestamp"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, evaluated in double precision."""
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either side has zero norm."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def sigmoid(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def hash_order(*cols: str | Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random order key: md5 of the key columns and the seed.

    The same string is produced by DuckDB's ``md5(concat_ws('|', ...))``, so
    orderings built on it are oracle-checkable.
    """
    parts = [col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(*cols: str | Column, seed: int = 42) -> Column:
    """Uniform double in [0, 1) from a seeded 64-bit hash of the key columns."""
    h = F.xxhash64(*[col(c) for c in cols], F.lit(seed))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))


def round6(c: str | Column) -> Column:
    return F.round(col(c), 6)
