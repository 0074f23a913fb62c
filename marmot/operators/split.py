"""Temporal and random splits, exact quantiles, active-user filter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.functions import columns as C
from marmot.functions.index import global_index
from marmot.functions.order import order_statistics


def time_quantiles(df: DataFrame, ts: str = "ts", probs: Sequence[float] = (S.TRAIN_QUANTILE, S.VAL_QUANTILE),
                   exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row ``q0, q1, ...`` of quantiles of ``ts`` in epoch microseconds (linear interpolation).

    exact (default): radix selection of the two neighbours of every position (n - 1) * p, at
    every size (see functions.order); approximate: ``percentile_approx``.
    """
    x = C.ts_micros(ts)
    if not exact:
        q = F.percentile_approx("_x", list(probs), accuracy)
        return df.select(x.alias("_x")).where("_x is not null").agg(q.alias("_q")).select(
            *[F.col("_q")[i].cast("double").alias(f"q{i}") for i in range(len(probs))])
    spots: list[tuple[float, int, int]] = []

    def ranks(n: int) -> list[int]:
        for p in probs:
            h = (n - 1) * float(p)
            spots.append((h, math.floor(h), min(math.floor(h) + 1, n - 1)))
        return [r for _, low, high in spots for r in (low, high)]

    n, places = order_statistics(df, x, ranks)
    if not n:
        return _null_row(df, probs)
    values = [float(lo.value) + (h - low) * float(hi.value - lo.value)
              for (h, low, _), lo, hi in zip(spots, places[::2], places[1::2], strict=True)]
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"q{i} DOUBLE" for i in range(len(probs))))


def _null_row(x: DataFrame, probs) -> DataFrame:
    return x.sparkSession.createDataFrame([tuple([None] * len(probs))],
                                          ", ".join(f"q{i} DOUBLE" for i in range(len(probs))))


def active_users(df: DataFrame, user: str = "user_idx", min_rows: int = S.MIN_TRAIN_ROWS) -> DataFrame:
    """Rows of users with at least ``min_rows`` rows (partial counts combine map-side)."""
    keep = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(user)
    return df.join(keep, user, "left_semi")


def temporal_split(df: DataFrame, ts: str = "ts", train_q: float = S.TRAIN_QUANTILE,
                   val_q: float = S.VAL_QUANTILE, min_train: int = S.MIN_TRAIN_ROWS,
                   user: str = "user_idx", exact: bool = True) -> DataFrame:
    """Add ``split``: train ts <= q(train_q); val q(train_q) < ts <= q(val_q); test above.

    Train keeps only users with ``min_train`` train rows (val/test untouched).
    One table partitioned by ``split`` replaces three files.
    """
    q = time_quantiles(df, ts, (train_q, val_q), exact=exact)
    row = q.first()  # one row, two numbers: the cut-offs become literals
    q70, q85 = F.lit(row["q0"]), F.lit(row["q1"])
    x = C.ts_micros(ts)
    tagged = df.withColumn("split", F.when(x <= q70, "train").when(x <= q85, "val").otherwise("test"))
    train = active_users(tagged.where(F.col("split") == "train"), user, min_train)
    return train.unionByName(tagged.where(F.col("split") != "train"))


def random_split(df: DataFrame, keys: Sequence[str] = ("user_idx", "item_idx"),
                 ratios: Sequence[float] = S.SPLIT_RATIOS, seed: int = 42) -> DataFrame:
    """Exact-count seeded split: in the order of md5(keys|seed), the first int(n*r_train) rows
    go to train, the next int(n*r_val) to val, the rest to test.  The order is reproducible in SQL.

    The two cut values are found by radix selection over the first 60 bits of the hash and
    rows are tagged by comparison: no row is moved.  Only where rows with one cut value fall on both
    sides (repeated pairs) are these numbered, in the order of hash and keys.
    """
    cut: list[int] = []

    def ranks(n: int) -> list[int]:
        n_train = int(n * ratios[0])
        cut.extend((n_train, n_train + int(n * ratios[1])))
        return cut

    digest = C.hash_order(*keys, seed=seed)
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    _, places = order_statistics(df, key, ranks, span=(0, (1 << 60) - 1))
    names = ("train", "val")
    tag = F.lit("test")
    for at, name in reversed(list(zip(places, names, strict=True))):  # a cut beyond the last row takes all
        tag = F.lit(name) if at is None else F.when(F.col("_h") < at.value, name).otherwise(tag)
    torn = sorted({at.value for r, at in zip(cut, places, strict=True) if at is not None and at.below < r})
    keyed = df.withColumn("_h", key)
    if not torn:
        return keyed.withColumn("split", tag).drop("_h")
    # rows that tie with a cut value, numbered from the rows below it
    out = keyed.where(~F.col("_h").isin(torn)).withColumn("split", tag)
    for value in torn:
        tied = keyed.where(F.col("_h") == value).withColumn("_d", digest)
        below = next(at.below for at in places if at is not None and at.value == value)
        ranked = global_index(tied, ["_d", *[F.col(k) for k in keys]], "_pos", start=below, spread_ties=True)
        out = out.unionByName(ranked.withColumn("split", F.when(F.col("_pos") < cut[0], "train").when(F.col("_pos") < cut[1], "val")
                                                .otherwise("test")).drop("_d", "_pos"))
    return out.drop("_h")
