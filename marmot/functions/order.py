"""Exact order statistics of a 64-bit key by radix selection: no sort, no checkpoint.

A pass counts the rows by the next digit of the key among the rows that can still hold an
asked rank; the counts (at most 2**DIGIT a rank) tell which digit each rank has.  Passes
combine map-side and read the key column only.  As soon as few rows are left for all
ranks, these are fetched and the ranks read off them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 12
#: rows left for a rank that are fetched instead of counted once more
FEW = 4096
_TOP = 1 << 63


@dataclass(frozen=True)
class Place:
    """The key at a rank, the rows with a smaller key, the rows with this one."""
    value: int
    below: int
    equal: int


@dataclass
class _Search:
    rank: int  # among all rows
    low: int  # the keys that can hold it, both ends included
    high: int
    below: int  # rows with a smaller key than these
    rows: int  # rows with one of these keys


def order_statistics(df: DataFrame, key: Column, ranks: Callable[[int], Sequence[int]],
                     span: tuple[int, int] | None = None) -> tuple[int, list[Place | None]]:
    """(rows with a key, the Place of every 0-based rank); a rank outside the rows has none.

    ``ranks`` is called with the number of rows.  ``span`` are bounds of the keys if they are
    known; otherwise a first pass finds them.  Null keys are left out.
    """
    keys = df.select(key.cast("bigint").alias("_key")).where("_key is not null")
    if span is None:
        first = keys.agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).first()
        if not first["n"]:
            return 0, [None for _ in ranks(0)]
        n, low, high = first["n"], first["low"], first["high"]
        asked = list(ranks(n))
    else:
        n, (low, high), asked = None, span, None
    whole = _Search(0, low, high, 0, n or 0)
    if asked is None:
        counts = _counts(keys, [whole])
        n = sum(c for _, c in counts[0])
        asked = list(ranks(n))
        searches = {r: _narrowed(_Search(r, low, high, 0, n), counts[0]) for r in asked if 0 <= r < n}
    else:
        searches = {r: _Search(r, low, high, 0, n) for r in asked if 0 <= r < n}
    while True:
        open_ = [s for s in searches.values() if s.low < s.high and s.rows > FEW]
        if not open_:
            break
        for s, counted in zip(open_, _counts(keys, open_), strict=True):
            searches[s.rank] = _narrowed(s, counted)
    few = {(s.low, s.high) for s in searches.values() if s.low < s.high}
    left: list[int] = []
    if few:
        left = sorted(r[0] for r in keys.where(_within(few)).collect())  # at most FEW rows a rank
    out: list[Place | None] = []
    for r in asked:
        if r not in searches:
            out.append(None)
            continue
        s = searches[r]
        if s.low == s.high:
            out.append(Place(s.low, s.below, s.rows))
            continue
        own = [x for x in left if s.low <= x <= s.high]
        value = own[r - s.below]
        out.append(Place(value, s.below + sum(x < value for x in own), sum(x == value for x in own)))
    return n, out


def _within(ranges: set[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for low, high in sorted(ranges):
        cond = cond | F.col("_key").between(F.lit(low), F.lit(high))
    return cond


def _width(s: _Search) -> int:
    """Keys of one digit of the search's range."""
    return 1 << max(0, (s.high - s.low).bit_length() - DIGIT)


def _counts(keys: DataFrame, searches: list[_Search]) -> list[list[tuple[int, int]]]:
    """Per search the (digit, rows) of its range in order, by one aggregation for all."""
    ranges = sorted({(s.low, s.high) for s in searches})
    which, digit = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, (low, high) in enumerate(ranges):
        inside = F.col("_key").between(F.lit(low), F.lit(high))
        shift = _width(_Search(0, low, high, 0, 0)).bit_length() - 1
        # the difference may pass 2**63: it is read as an unsigned number
        step = F.shiftrightunsigned(F.col("_key") - F.lit(low), shift) if high - low < _TOP else \
            F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-_TOP)), shift) - F.lit((low + _TOP) >> shift)
        which, digit = F.when(inside, F.lit(i)).otherwise(which), F.when(inside, step).otherwise(digit)
    found = (keys.where(_within(set(ranges))).groupBy(which.alias("i"), digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    by = {r: sorted((x["d"], x["n"]) for x in found if x["i"] == i) for i, r in enumerate(ranges)}
    return [by[s.low, s.high] for s in searches]


def _narrowed(s: _Search, counted: list[tuple[int, int]]) -> _Search:
    width, below = _width(s), s.below
    aligned = s.low if s.high - s.low < _TOP else -_TOP + (((s.low + _TOP) // width) * width)
    for d, n in counted:
        if s.rank < below + n:
            low = max(s.low, aligned + d * width)
            return _Search(s.rank, low, min(s.high, aligned + d * width + width - 1), below, n)
        below += n
    raise AssertionError("the rows changed between passes")
