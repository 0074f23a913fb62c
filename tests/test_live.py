"""Popularity and statistics by deltas: equal to a full recount after any batches."""
import os
import random

import pytest
from pyspark.sql import functions as F

from marmot.operators import popularity as POP
from marmot.operators import stats as ST
from marmot.streaming import bucketed as BK
from marmot.streaming import live as LV

TRAINING = "user_idx STRING, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT"


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def _check(spark, root):
    """Everything the state answers, against the table itself."""
    table, st = BK.read(spark, root).checkpoint(), LV.state(spark, root)
    assert LV.refreshed(spark, root) == BK.current(spark, root)
    assert _rows(LV.dataset_stats(st)) == _rows(ST.dataset_stats(table))
    want = POP.composite_scores(table, carry=("category_idx",)).select("item_idx", "category_idx", "weight_sum", "n_users", "popularity_score")
    assert _rows(LV.item_popularity(st).select(*want.columns)) == _rows(want)
    assert _rows(LV.item_popularity(st).select("item_idx", "n_interactions")) == _rows(POP.counts(table))
    want = table.groupBy("category_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_idx").alias("n_items"))
    assert _rows(LV.category_distribution(st).select(*want.columns)) == _rows(want)
    whole = LV.signed_sums(LV.changes(spark, root, None, BK.current(spark, root)).withColumn("_user", F.col("user_idx")))
    assert _rows(st) == _rows(whole)
    return st


def _batch(rng, n, users=12, items=9):
    # weights with tenths, so that float sums would leave a residue; categories and labels change with the action
    def one():
        w = rng.choice([0.1, 0.7, 1.0, 5.0, None])
        return (rng.choice([None, *[f"u{i}" for i in range(users)]]), rng.choice([None, *range(items)]), rng.choice([0, 1, None]),
                w, rng.choice([0.5, -0.5]), rng.choice([1, 2, None]))
    return [one() for _ in range(n)]


def test_any_batches_equal_a_full_recount(spark, tmp_dir):
    rng, root = random.Random(5), f"{tmp_dir}/t"
    BK.create(spark, root, spark.createDataFrame(_batch(rng, 40), TRAINING), buckets=4)
    assert LV.refreshed(spark, root) is None
    LV.refresh(spark, root)
    _check(spark, root)
    for k in range(4):
        BK.merge_batch(spark, root, spark.createDataFrame(_batch(rng, 6 + k), TRAINING), f"b{k}")
        if k != 1:  # version 2 gets no state of its own: the next delta spans two versions
            LV.refresh(spark, root)
            _check(spark, root)
    names = os.listdir(f"{root}/live")
    assert "to=000000000003,from=000000000001" in names and len([n for n in names if n.endswith("from=base")]) >= 2   # folded
    before = _rows(LV.state(spark, root))
    assert LV.vacuum(spark, root) and _rows(LV.state(spark, root)) == before


def test_a_heavier_action_takes_the_old_row_back(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    BK.create(spark, root, spark.createDataFrame([("a", 1, 0, 1.0, 0.0, 2), ("b", 1, 1, 1.0, 0.0, 2)], TRAINING), buckets=2)
    LV.refresh(spark, root)
    BK.merge_batch(spark, root, spark.createDataFrame([("a", 1, 1, 5.0, 0.0, 3), ("b", 1, 1, 0.5, 0.0, 1)], TRAINING), "one")
    LV.refresh(spark, root)
    moved = LV.delta(spark, root, 0, 1).where("not of_user").select("category_idx", "n_rows", "weight", "n_positive", "n_negative")
    assert sorted((r[0], r[1], float(r[2]), r[3], r[4]) for r in moved.collect()) == [(2, -1, -1.0, 0, -1), (3, 1, 5.0, 1, 0)]
    assert _check(spark, root).where("of_user").count() == 2


def test_stops_replays_and_lost_versions(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/t"
    new = lambda user, item: spark.createDataFrame([(user, item, 1, 1.0, 0.0, 1)], TRAINING)
    BK.create(spark, root, spark.createDataFrame([], TRAINING), buckets=4)
    LV.refresh(spark, root)
    assert LV.state(spark, root).count() == 0 and LV.dataset_stats(LV.state(spark, root)).first()["n_records"] == 0
    assert LV.category_distribution(LV.state(spark, root)).count() == 0
    BK.merge_batch(spark, root, new("a", 1), "one")
    with monkeypatch.context() as m:
        m.setattr(LV, "delta", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            LV.refresh(spark, root)
    assert LV.refreshed(spark, root) == 0 and LV.state(spark, root).count() == 0     # the former state stays readable
    os.makedirs(f"{root}/live/to=000000000001,from=000000000000")                    # what a stopped writer leaves
    assert LV.refresh(spark, root) == 1 and LV.refresh(spark, root) == 1
    _check(spark, root)
    for k in range(4):
        BK.merge_batch(spark, root, new(f"n{k}", k), f"later {k}")
    BK.vacuum(spark, root, keep=1)                                                   # the state's version is no longer there
    assert LV.refresh(spark, root) == 5                                              # created 0, "one" 1, four later batches
    _check(spark, root)
    with pytest.raises(FileNotFoundError):
        LV.state(spark, f"{tmp_dir}/none")


def test_a_delta_follows_the_batch(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    base = spark.range(6000).select(F.concat(F.lit("u"), F.col("id") % 600).alias("user_idx"), (F.col("id") % 1001).alias("item_idx"),
                                    F.lit(1).alias("label"), F.lit(1.0).alias("weight"), F.lit(0.1).alias("price_norm"), F.lit(2).alias("category_idx"))
    BK.create(spark, root, base, buckets=32)
    LV.refresh(spark, root)
    BK.merge_batch(spark, root, spark.createDataFrame([("u3", 77, 1, 5.0, 0.1, 2), ("u3", 5000, 1, 1.0, 0.1, 2)], TRAINING), "one")
    changed = LV.changes(spark, root, 0, 1)
    assert changed.count() < 0.2 * 2 * 6000                                          # one bucket of 32, of both versions
    assert LV.delta(spark, root, 0, 1).count() <= 3                                  # two items and one user
    LV.refresh(spark, root)
    assert "to=000000000001,from=base" not in os.listdir(f"{root}/live")
    _check(spark, root)
