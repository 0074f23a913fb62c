"""Benchmark decontamination: prefix-filtered set join of document text with item windows.

An item's windows are its runs of 10 consecutive words (the whole item if it is
shorter); equal windows are one, with all its items.  A window's elements are its 3-word shingles; a global order of the
shingles by their frequency over **all documents**, rarest first, makes the
rarest shingle the necessary prefix of an exact containment: a document without
it holds no occurrence.  Documents meet windows on that shingle only; the
shingle's place in the window and in the document fixes where the window would
begin (positional bound) and whether it fits (length bound), and the words there
are then compared one by one.

The benchmark is the stated query set.  It is taken in blocks of a bounded number
of words; each block is broadcast and all documents run past it, accumulating per
row, so nothing is shuffled but the shingle counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import ALNUM, prepare, hashed_words, lowered, rows, shingles

WINDOW, SHINGLE = 10, 3
#: words of benchmark text in one broadcast block: about 8 bytes each for words, windows and shingles
BLOCK_WORDS = 2_000_000
#: candidate (place, window) pairs of a document compared at a time; bounds memory, drops none
CANDIDATES = 1_000_000


class Block:
    """Distinct windows of one block of items: their words, owners and prefix shingles, as flat arrays.

    A window that occurs many times, in one item or in several, is held once with the list of its
    items, so a repetitive item costs no more than its different windows.
    """

    def __init__(self, items: list[tuple[str, bytes]]):
        words, bounds = hashed_words([t for _, t in items], ALNUM)
        self.names = [n for n, _ in items]
        self.words = words
        none = np.zeros(0, dtype=np.int64)
        begin, length, owner, content, tokens = [none], [none], [none], [none.view(np.uint64)], [none.view(np.uint64)]
        for i in range(len(items)):
            own = words[bounds[i] : bounds[i + 1]]
            windows = shingles(own, WINDOW)  # a window's fingerprint has its length in it
            begin.append(bounds[i] + np.arange(len(windows)))
            length.append(np.full(len(windows), min(WINDOW, len(own))))
            owner.append(np.full(len(windows), i))
            content.append(windows)
            tokens.append(shingles(own, SHINGLE))
        begin, length, owner = (np.concatenate(x).astype(np.int64) for x in (begin, length, owner))
        _, first, window = np.unique(np.concatenate(content), return_index=True, return_inverse=True)
        self.begin, self.length = begin[first], length[first]
        # the items of window w are owners[owner_at[w] : owner_at[w + 1]]
        pairs = np.unique(window * max(1, len(items)) + owner)
        self.owners = pairs % max(1, len(items))
        self.owner_at = np.searchsorted(pairs // max(1, len(items)), np.arange(len(first) + 1))
        self.lengths = sorted({min(SHINGLE, int(x)) for x in np.unique(self.length)})
        self.tokens = np.unique(np.concatenate(tokens))

    def choose_prefixes(self, counts: dict[int, int]) -> None:
        """Fix each window's rarest shingle; ties go to the smaller fingerprint, then the first place."""
        token, offset, size = [], [], []
        for b, n in zip(self.begin, self.length, strict=True):
            own = shingles(self.words[b : b + n], SHINGLE)
            best = min(range(len(own)), key=lambda j: (counts.get(int(own[j]), 0), int(own[j]), j))
            token.append(own[best])
            offset.append(best)
            size.append(min(SHINGLE, int(n)))
        token = np.array(token, dtype=np.uint64)
        order = np.argsort(token, kind="stable")
        self.token = token[order]
        self.offset = np.array(offset, dtype=np.int64)[order]
        self.size = np.array(size, dtype=np.int64)[order]
        self.begin, self.length, self.window = self.begin[order], self.length[order], order
        self.prefixes = np.unique(self.token)

    def hits(self, words: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Begins and ends of the document's word intervals that windows cover (overlapping ones as one), and the
        items that have a window there."""
        starts, ends, seen = [], [], np.zeros(0, dtype=np.int64)
        for start, window in self._occurrences(words):
            starts.append(start)
            ends.append(start + self.length[window])
            seen = np.union1d(seen, self.window[window])
        if not len(seen):
            return [], [], []
        # merge: an interval opens where a begin lies beyond every end before it
        s, e = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order])
        opens = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        closes = np.concatenate([opens[1:], [len(s)]]) - 1
        owners = np.unique(np.concatenate([self.owners[self.owner_at[w] : self.owner_at[w + 1]] for w in seen]))
        return s[opens].tolist(), e[closes].tolist(), owners.tolist()

    def _occurrences(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(begins, windows) of occurrences, at most about CANDIDATES candidates compared at a time."""
        for k in self.lengths:
            if len(words) < k or not len(self.prefixes):
                continue
            own = shingles(words, k)
            slot = np.searchsorted(self.prefixes, own)
            slot[slot == len(self.prefixes)] = 0
            places = np.flatnonzero(self.prefixes[slot] == own)
            lo = np.searchsorted(self.token, own[places], "left")
            n = np.searchsorted(self.token, own[places], "right") - lo
            total = np.cumsum(n)
            at = 0
            while at < len(places):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
                yield self._compared(words, k, places[at:to], lo[at:to], n[at:to])
                at = to

    def _compared(self, words: np.ndarray, k: int, places: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(places, n)
        window = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = at - self.offset[window]
        fits = (self.size[window] == k) & (start >= 0) & (start + self.length[window] <= len(words))
        start, window = start[fits], window[fits]
        same = np.ones(len(start), dtype=bool)
        for j in range(WINDOW):
            live = np.flatnonzero(same & (self.length[window] > j))
            same[live] = words[start[live] + j] == self.words[self.begin[window[live]] + j]
        return start[same], window[same]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most BLOCK_WORDS words (by a size bound on their bytes), one block at a time on the driver."""
    block, size = [], 0
    ordered = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for item, text in ordered.toLocalIterator():
        raw = text.encode().lower()
        if block and size + len(raw) > 2 * BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    if block:
        yield block


def _counter(tokens: np.ndarray, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), dtype=np.int64)
        for batch in rows(batches):
            words, bounds = hashed_words(lowered(batch.column(0)), ALNUM)
            for i in range(batch.num_rows):
                for k in lengths:
                    if bounds[i + 1] - bounds[i] >= k:
                        own = shingles(words[bounds[i] : bounds[i + 1]], k)
                        slot = np.searchsorted(tokens, own)
                        slot[slot == len(tokens)] = 0
                        there = tokens[slot] == own
                        if there.any():
                            total += np.bincount(slot[there], minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[seen].view(np.int64)), pa.array(total[seen])], names=["token", "n"])
    return run


HIDDEN = (("_cd_words", "bigint"), ("_cd_begins", "array<bigint>"), ("_cd_ends", "array<bigint>"), ("_cd_items", "array<string>"))


def _matcher(block_var, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_var.value
        for batch in rows(batches):
            words, bounds = hashed_words(lowered(batch.column(text)), ALNUM)
            at = batch.num_columns - len(HIDDEN)
            begins, ends, items = (batch.column(at + i).to_pylist() for i in (1, 2, 3))
            for i in range(batch.num_rows):
                s, e, o = block.hits(words[bounds[i] : bounds[i + 1]])
                begins[i], ends[i], items[i] = begins[i] + s, ends[i] + e, items[i] + [block.names[x] for x in o]
            new = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(begins, pa.list_(pa.int64())),
                   pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), *new], names=batch.schema.names)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the word intervals that are windows of ``benchmark`` items, as the columns named in HIDDEN.

    One row per input row, all its columns kept.  A null text has no words; a null
    item or null item_id is no item; items of the same text are all reported,
    repeated item_ids once.  Ids are never compared, so null and repeated doc_ids are
    rows like any other.  An empty benchmark hits nothing, an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    empty = {"bigint": F.lit(0), "array<bigint>": F.array(), "array<string>": F.array()}
    out = docs.select("*", *(empty[kind].cast(kind).alias(name) for name, kind in HIDDEN))
    schema, text = out.schema, docs.columns.index("text")
    for items in _first(_blocks(benchmark)):
        block = Block(items)
        counts = []
        if len(block.tokens):
            counts = (docs.select(F.col("text").cast("string")).mapInArrow(_counter(block.tokens, block.lengths), "token bigint, n bigint")
                      .groupBy("token").agg(F.sum("n").alias("n")).collect())  # at most the block's own shingles
        block.choose_prefixes({r["token"] & (2**64 - 1): r["n"] for r in counts})
        out = out.mapInArrow(_matcher(spark.sparkContext.broadcast(block), text), schema)
    return out


def _first(blocks: Iterator[list]) -> Iterator[list]:
    """At least one block, so that the word counts are made for an empty benchmark too."""
    some = False
    for b in blocks:
        some = True
        yield b
    if not some:
        yield []


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        hit, n_items, digest = [], [], []
        for n, begins, ends, items in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, begins, 1)
            np.subtract.at(edge, ends, 1)
            hit.append(int((np.cumsum(edge[:-1]) > 0).sum()))
            names = sorted(set(items))
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()),
                                          pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                                         names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``contamination``'s rows."""
    return found.select(F.col("doc_id").cast("bigint"), *(n for n, _ in HIDDEN)).mapInArrow(
        _summary, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; all columns are kept."""
    return contamination(docs, benchmark).where(F.size("_cd_begins") == 0).drop(*(n for n, _ in HIDDEN))
