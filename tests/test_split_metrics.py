"""F6-F8: popularity, splits, ranking metrics; the global index."""
import datetime as dt

from pyspark.sql import functions as F

from marmot.functions.index import global_index
from marmot.operators import metrics as M
from marmot.operators import popularity as POP
from marmot.operators import split as SP


def test_global_index_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    out = global_index(df, ["k"], "i").collect()
    pairs = sorted((r["k"], r["i"]) for r in out)
    assert [i for _, i in pairs] == list(range(5000))


def test_f6_popularity_composite(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1), (2, 1, 1.0, 1), (1, 2, 3.0, 2)],
                               "user_idx BIGINT, item_idx BIGINT, weight DOUBLE, category_idx INT")
    s = {r["item_idx"]: r["popularity_score"] for r in POP.composite(df, 10).collect()}
    assert s == {1: 1.0, 2: 0.5}
    s2 = {r["item_idx"]: r["popularity_score"] for r in POP.composite(df, 10, available=[2]).collect()}
    assert s2 == {2: 0.5}                                               # maxima from all items
    assert [r["item_idx"] for r in POP.composite(df, 10, category=2).collect()] == [2]


def test_f7_temporal_split(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(7, i, base + dt.timedelta(seconds=i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "user_idx BIGINT, item_idx BIGINT, ts TIMESTAMP")
    q = SP.time_quantiles(df).first()
    t0 = int(base.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert abs((q["q0"] - t0) / 1e6 - 7.3) < 1e-6 and abs((q["q1"] - t0) / 1e6 - 8.65) < 1e-6
    out = {r["item_idx"]: r["split"] for r in SP.temporal_split(df).collect()}
    assert [out[i] for i in range(1, 11)] == ["train"] * 7 + ["val"] + ["test"] * 2


def test_f7_random_split_counts(spark):
    df = spark.createDataFrame([(u, u) for u in range(10)], "user_idx BIGINT, item_idx BIGINT")
    c = {r["split"]: r["count"] for r in SP.random_split(df).groupBy("split").count().collect()}
    assert c == {"train": 7, "val": 1, "test": 2}
    a = sorted(tuple(r) for r in SP.random_split(df, seed=3).collect())
    b = sorted(tuple(r) for r in SP.random_split(df, seed=3).collect())
    assert a == b


def test_f8_metrics(spark):
    recs = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4, 5)] + [(2, 7, 1)] + [(4, 1, 1)],
                                 "user_idx BIGINT, item_idx BIGINT, rank INT")
    rel = spark.createDataFrame([(1, 2), (1, 9), (1, 2), (2, 8), (3, 1)], "user_idx BIGINT, item_idx BIGINT")
    per = {(r["user_idx"], r["k"]): r for r in M.at_k(recs, rel, ks=(5,)).collect()}
    u1 = per[(1, 5)]
    assert round(u1["precision"], 6) == 0.2 and round(u1["recall"], 6) == round(1 / 3, 6)
    assert round(u1["dcg"], 6) == 0.63093 and round(u1["ndcg"], 6) == 0.296082 and u1["hit_rate"] == 1.0
    u2 = per[(2, 5)]
    assert u2["precision"] == 0.0 and u2["ndcg"] == 0.0 and u2["hit_rate"] == 0.0      # no hits, short list
    assert (3, 5) not in per and (4, 5) not in per          # no recommendations / not relevant: skipped
    ev = M.evaluate(recs, rel, ks=(5,)).first()
    assert ev["evaluated_users"] == 2 and ev["total_users"] == 3


def test_quantile_bracket_equals_percentile(spark):
    from marmot.functions.columns import ts_micros
    from marmot.sources import testdata as TD
    rows = TD.training_rows(spark, "/root/testdata/sf0.001")
    exact = rows.select(ts_micros("ts").alias("x")).agg(F.percentile("x", [0.7, 0.85]).alias("q")).first()["q"]
    for accuracy in (50, 10000):
        assert list(SP.time_quantiles(rows, accuracy=accuracy).first()) == exact
    assert list(SP.time_quantiles(rows.where("false")).first()) == [None, None]


def test_global_index_spreads_a_hot_value(spark):
    df = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = global_index(df, ["k"], "i", partitions=8, spread_ties=True)
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 4000 / 3                 # the hot value is split
    ks = [r["k"] for r in out.orderBy("i").collect()]
    assert ks == sorted(ks) and out.select("i").distinct().count() == 4000


def test_metrics_agree_with_ranking_evaluator(spark):
    """Cross-check with Spark ML's RankingEvaluator where its set semantics coincide
    (distinct relevant items, k no longer than every list)."""
    from pyspark.ml.evaluation import RankingEvaluator
    recs = [(1, [1, 2, 3, 4, 5]), (2, [5, 6, 7, 8, 9]), (3, [9, 1, 4, 2, 7])]
    rel = [(1, [2, 9]), (2, [5, 1, 7]), (3, [3])]
    rows = [(u, it, r + 1) for u, lst in recs for r, it in enumerate(lst)]
    relrows = [(u, it) for u, lst in rel for it in lst]
    ours = M.evaluate(spark.createDataFrame(rows, "user_idx BIGINT, item_idx BIGINT, rank INT"),
                      spark.createDataFrame(relrows, "user_idx BIGINT, item_idx BIGINT"), ks=(5,)).first()
    pairs = spark.createDataFrame([([float(x) for x in r], [float(x) for x in dict(rel)[u]]) for u, r in recs],
                                  "prediction ARRAY<DOUBLE>, label ARRAY<DOUBLE>")
    ev = RankingEvaluator(predictionCol="prediction", labelCol="label", k=5)
    assert abs(ev.setMetricName("precisionAtK").evaluate(pairs) - ours["precision"]) < 1e-9
    assert abs(ev.setMetricName("recallAtK").evaluate(pairs) - ours["recall"]) < 1e-9
    assert abs(ev.setMetricName("ndcgAtK").evaluate(pairs) - ours["ndcg"]) < 1e-9


def test_order_statistics_by_radix(spark, monkeypatch):
    import random

    from marmot.functions import order as O
    monkeypatch.setattr(O, "FEW", 5)
    monkeypatch.setattr(O, "DIGIT", 3)
    rng = random.Random(2)
    wide = [-(2**63), 2**63 - 1, -1, 0, 1, *(rng.randint(-(2**63), 2**63 - 1) for _ in range(200))]
    for values in ([7], [5] * 300, [rng.randint(0, 40) for _ in range(500)], [rng.randint(-10**12, 10**12) for _ in range(300)], wide):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v BIGINT").repartition(3)
        want = sorted(values)
        asked = sorted({0, len(want) // 3, len(want) // 2, len(want) - 1})
        n, got = O.order_statistics(df, F.col("v"), lambda n: [*asked, n])
        assert n == len(want) and got[-1] is None
        for r, p in zip(asked, got):
            assert (p.value, p.below, p.equal) == (want[r], sum(x < want[r] for x in want), want.count(want[r])), r
    assert O.order_statistics(df.where("false"), F.col("v"), lambda n: [0]) == (0, [None])


def test_random_split_tears_repeated_rows_exactly(spark):
    """A third of all rows are one pair: the counts stay exact, no sort of the table is planned."""
    import hashlib
    rows = [(1, 1)] * 200 + [(u, 7) for u in range(2, 402)]
    df = spark.createDataFrame(rows, "user_idx BIGINT, item_idx BIGINT")
    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|{r[1]}|5".encode()).hexdigest())
    hot = order.index((1, 1))
    for ratios in ((0.7, 0.15, 0.15), ((hot + 50.5) / 600, 100 / 600, 0.1), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)):
        got = SP.random_split(df, ratios=ratios, seed=5).collect()
        n_train, n_val = int(600 * ratios[0]), int(600 * ratios[1])
        want = {"train": order[:n_train], "val": order[n_train:n_train + n_val], "test": order[n_train + n_val:]}
        for name, own in want.items():
            assert sorted((r["user_idx"], r["item_idx"]) for r in got if r["split"] == name) == sorted(own), (ratios, name)
    plan = SP.random_split(spark.range(3000).select(F.col("id").alias("user_idx"), F.col("id").alias("item_idx")))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_category_distribution_and_model_stats(spark):
    from marmot.operators import stats as ST
    df = spark.createDataFrame([("a", 1, 1, 10), ("a", 1, 1, 11), ("a", 2, None, 10), ("b", 3, 2, None), ("b", None, 2, 12), (None, 1, 1, 13)],
                               "split STRING, user_idx BIGINT, category_idx INT, item_idx BIGINT")
    got = {(r["split"], r["category_idx"]): (r["n_rows"], round(r["share"], 3)) for r in ST.category_distribution(df, "split").collect()}
    assert got == {("a", 1): (2, 0.667), ("a", None): (1, 0.333), ("b", 2): (2, 1.0), (None, 1): (1, 1.0)}
    assert {r["category_idx"]: round(r["share"], 3) for r in ST.category_distribution(df).collect()} == {1: 0.5, 2: 0.333, None: 0.167}
    assert ST.category_distribution(df.limit(0)).count() == 0 and ST.category_distribution(df.limit(0), "split").count() == 0

    class Model:
        rank = 4
        user_factors = staticmethod(lambda: spark.createDataFrame([(1, [0.0]), (2, [0.0]), (9, [0.0])], "user_idx BIGINT, embedding ARRAY<DOUBLE>"))
        item_factors = staticmethod(lambda: spark.createDataFrame([(10, [0.0])], "item_idx BIGINT, embedding ARRAY<DOUBLE>"))

    assert ST.model_stats(Model, df).first().asDict() == {"model_rank": 4, "model_users": 3, "model_items": 1, "unknown_users": 1, "unknown_items": 3}
