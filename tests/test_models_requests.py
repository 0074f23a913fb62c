"""Model invariants and the reference's valid request shapes as one request table."""
import pytest
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators import ranker as RK
from marmot.plans import etl as ETL
from marmot.plans import serve as SV
from marmot.sources import testdata as TD

SF = "/root/testdata/sf0.001"

# fixed request shapes (FIXTURES F5): lists of 5 / 10 / 20 items (ids mod 100), with and without category 1
L5 = [15, 42, 89, 56, 3]
L10 = [15, 16, 17, 42, 78, 88, 89, 56, 3, 33]
L20 = [15, 16, 17, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 42, 78, 88, 89, 56, 3, 33]


def test_no_time_leak_between_splits(spark):
    s = ETL.splits(spark, SF)
    b = {r["split"]: (r["lo"], r["hi"]) for r in s.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    assert b["train"][1] <= b["val"][0] and b["val"][1] <= b["test"][0]


def test_nonneg_factors_and_als_beats_random(spark):
    train = ETL.split_part(spark, SF, "train").select(*S.TRAINING_COLUMNS)
    nmf = RK.fit_nonneg_mf(train, rank=4, max_iter=5)
    assert nmf.item_factors().where(~F.forall("embedding", lambda x: x >= 0)).count() == 0
    mf = RK.fit_mf(train, rank=8, max_iter=10)
    uf = mf.user_factors().withColumnRenamed("embedding", "u")
    itf = mf.item_factors().withColumnRenamed("embedding", "i")
    from marmot.functions.columns import dot
    pos = train.select("user_idx", "item_idx").distinct()
    pairs = uf.join(itf, how="cross").select("user_idx", "item_idx", dot("u", "i").alias("s"))  # tiny fixture
    scored = pairs.join(pos.withColumn("p", F.lit(1)), ["user_idx", "item_idx"], "left")
    m = {r["p"]: r["m"] for r in scored.groupBy("p").agg(F.avg("s").alias("m")).collect()}
    assert m[1] > m[None]


def test_valid_request_shapes(spark):
    train = ETL.split_part(spark, SF, "train")
    known = train.select("user_idx").first()[0]
    new_user = 10 ** 9
    shapes = []
    rid = 0
    for user in (known, new_user):
        for lst, cat in ((L5, None), (L10, None), (L20, None), (L20, 1)):
            rid += 1
            shapes.append((rid, user, 10, cat, lst, None))
    req = spark.createDataFrame(shapes, S.REQUEST_SCHEMA)
    out = SV.recommend(req, train, TD.user_vectors(spark, SF, req, "user_id").withColumnRenamed("user_vec", "embedding"),
                       TD.item_vectors(spark, SF), TD.given_ranker).collect()
    meta = {r["item_idx"]: r["category_idx"] for r in train.select("item_idx", "category_idx").distinct().collect()}
    by = {}
    for r in out:
        by.setdefault(r["request_id"], []).append(r)
    for rid_, user, _, cat, lst, _ in shapes:
        rows = [r for r in by[rid_] if r["item_id"] is not None]
        assert all(r["item_id"] in lst for r in rows)                      # availability respected
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
        assert len(rows) <= 10
        if cat is not None:
            assert all(meta[r["item_id"]] == cat for r in rows)            # category respected
        assert {r["has_next"] for r in by[rid_]} == {len(rows) < len(lst)}


def test_ranker_save_load_round_trip(spark, tmp_dir):
    train = ETL.split_part(spark, SF, "train").select(*S.TRAINING_COLUMNS)
    dims = RK.fit_dims(train)
    mf = RK.fit_mf(train, rank=4, max_iter=3, dims=dims)
    fm = RK.fit_ranker(train, max_iter=3, dims=dims)
    mlp = RK.fit_factor_ranker(train, mf, hidden=(8,), max_iter=5)
    cands = train.select("user_idx", "item_idx", "category_idx", "price_norm").distinct()
    for model, cls in ((fm, RK.RankerModel), (mlp, RK.FactorRankerModel)):
        path = f"{tmp_dir}/{cls.__name__}"
        model.save(path)
        back = cls.load(spark, path)
        a = {(r[0], r[1]): round(r[2], 9) for r in model.score(cands).select("user_idx", "item_idx", "ranker_score").collect()}
        b = {(r[0], r[1]): round(r[2], 9) for r in back.score(cands).select("user_idx", "item_idx", "ranker_score").collect()}
        assert a == b and len(a) == cands.count()


def test_prepare_dataset_job(spark, tmp_dir):
    ev = TD.events(spark, SF)
    it = TD.items(spark, SF)
    out = ETL.prepare_dataset(ev, it, f"{tmp_dir}/ds", vocab=S.EVENTS_ACTION_WEIGHTS)
    direct = ETL.splits(spark, SF)
    a = sorted((r["split"], r["user_idx"], r["item_idx"], r["weight"]) for r in out.collect())
    b = sorted((r["split"], r["user_idx"], r["item_idx"], r["weight"]) for r in direct.collect())
    assert a == b
    assert spark.read.parquet(f"{tmp_dir}/ds/encoders/category_dim").count() == 6


def test_simple_train_job(spark, tmp_dir):
    from marmot.plans import train as TR
    tr, va = ETL.split_part(spark, SF, "train"), ETL.split_part(spark, SF, "val")
    m = TR.simple_train(tr, va, f"{tmp_dir}/run", mf_factors=4, epochs=3, top_k=20, top_n=10).first()
    assert m["evaluated_users"] > 0 and 0.0 <= m["NDCG@10"] <= 1.0
    back = RK.MFModel.load(spark, f"{tmp_dir}/run/mf")
    assert back.item_factors().count() == tr.select("item_idx").distinct().count()


def test_recommend_all_serves_cold_users(spark):
    from marmot.plans import train as TR
    tr = ETL.split_part(spark, SF, "train")
    model = TR.train_hybrid(tr, mf_factors=4, als_iters=3, ranker_iters=3)
    users = spark.createDataFrame([(10 ** 9,)], "user_idx BIGINT").unionByName(tr.select("user_idx").limit(1))
    recs = TR.recommend_all(model, tr, users, top_k=20, top_n=5).collect()
    cold = [r for r in recs if r["user_idx"] == 10 ** 9]
    assert len(cold) == 5 and sorted(r["rank"] for r in cold) == [1, 2, 3, 4, 5]


def test_load_or_train(spark, tmp_dir):
    from marmot.plans import train as TR
    tr = ETL.split_part(spark, SF, "train")
    m1, loaded1 = TR.load_or_train_hybrid(tr, f"{tmp_dir}/hy", mf_factors=4, als_iters=2, ranker_iters=2)
    m2, loaded2 = TR.load_or_train_hybrid(tr, f"{tmp_dir}/hy", mf_factors=4, als_iters=2, ranker_iters=2)
    assert (loaded1, loaded2) == (False, True) and m2.mf.rank == 4


def test_grid_prefix_reuse_matches_direct_evaluation(spark):
    from marmot.operators import metrics as M
    from marmot.plans import train as TR
    tr, va = ETL.split_part(spark, SF, "train"), ETL.split_part(spark, SF, "val")
    grid = {"mf_factors": [4], "epochs": [3], "batch_size": [512], "top_k": [10, 20], "top_n": [3, 5]}
    res = {(r["top_k"], r["top_n"]): r for r in TR.grid_search(tr, va, grid, ks=(3, 5)).collect()}
    model = TR.train_hybrid(tr.select(*S.TRAINING_COLUMNS), mf_factors=4, als_iters=3, ranker_iters=3)
    for top_k, top_n in ((10, 3), (20, 5)):
        direct = M.wide(TR.evaluate_model(model, tr, va, top_k, top_n, ks=(3, 5))).first()
        for m in ("Precision@3", "NDCG@5", "HitRate@5"):
            assert abs(direct[m] - res[(top_k, top_n)][m]) < 1e-9
    assert sum(1 for r in res.values() if r["is_best"]) == 1


def test_serving_with_fitted_models(spark):
    from marmot.plans import train as TR
    tr = ETL.split_part(spark, SF, "train")
    model = TR.train_hybrid(tr, mf_factors=4, als_iters=3, ranker_iters=3)
    known = tr.select("user_idx").first()[0]
    req = spark.createDataFrame([(1, known, 5, None, L20, None), (2, 10 ** 9, 5, 2, L20, None)], S.REQUEST_SCHEMA)
    out = SV.recommend(req, tr.drop("split"), model.mf.user_factors(), model.mf.item_factors(),
                       lambda c: model.ranker.score(c, user="user_id")).collect()
    assert {r["request_id"] for r in out} == {1, 2}
    assert all(r["item_id"] is None or r["item_id"] in L20 for r in out)


def _fitted_on(monkeypatch, estimator, call):
    """(partitions, whether it is read from written rows) of the input that a Spark ML estimator gets."""
    seen = []

    class Stop(Exception):
        pass

    def fit(self, df, params=None):
        df = df if "_x" not in df.columns or "_u" not in df.columns else df.select("_u", "_i")
        seen.append((df.rdd.getNumPartitions(), "Exchange" not in df._jdf.queryExecution().executedPlan().toString()))
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(estimator, "fit", fit)
        with pytest.raises(Stop):
            call()
    return seen[0]


def test_solvers_get_written_rows_spread_over_all_cores(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.recommendation import ALS
    rows = [(u, i, 1, 5.0, 0.1, 1 + i % 6) for u in range(12) for i in range(10) if (u + i) % 3]
    t = spark.createDataFrame(rows, "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    cores = spark.sparkContext.defaultParallelism
    assert _fitted_on(monkeypatch, ALS, lambda: RK.fit_mf(t, rank=2, max_iter=1))[1]
    parts, written = _fitted_on(monkeypatch, Pipeline, lambda: RK.fit_ranker(t, max_iter=1))
    assert parts == cores and written
    mf = RK.fit_mf(t, rank=2, max_iter=1)
    assert mf.user_factors().count() == 12
    parts, written = _fitted_on(monkeypatch, MultilayerPerceptronClassifier, lambda: RK.fit_factor_ranker(t, mf, max_iter=1))
    assert parts >= cores and written


def test_grid_query_searches_the_reference_grid(spark, monkeypatch):
    from marmot.plans import catalog
    from marmot.plans import train as TR
    rows = spark.range(1).select(F.col("id").alias("user_idx"))
    seen = []
    monkeypatch.setattr(catalog, "train", lambda *a: rows)
    monkeypatch.setattr(catalog, "val", lambda *a: rows)
    monkeypatch.setattr(TR, "grid_search", lambda train, val, grid, **kw: seen.append(grid))
    catalog.QUERIES["grid_search"](spark, "unread")
    # server_fastAPI/train.py, quick tuning
    assert seen == [{"mf_factors": [30, 50], "epochs": [20, 30], "batch_size": [512], "top_k": [200, 250], "top_n": [50]}]
