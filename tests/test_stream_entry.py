"""Incremental stream = one-shot batch, restart from checkpoint; driver contract."""
import json
import os

from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators import prepare as P
from marmot.streaming import incremental as INC


def _write(path, rows):
    with open(path, "w") as f:
        json.dump(rows, f, indent=2)


def _log(ts, item, user, action, cat, price):
    return {"timestamp": ts, "item_id": item, "user_id": user, "action": action, "category_id": cat, "price": price}


def test_stream_equals_batch_and_restarts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    base = spark.createDataFrame([(1, 10, 1, 3.0, 0.1, 1), (2, 20, 1, 1.0, 0.2, 2)],
                                 "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    stats = spark.createDataFrame([(100.0, 10.0, 100.0)], "mean DOUBLE, std DOUBLE, var DOUBLE")
    _write(os.path.join(src, "a.json"), [_log(1, 10, "1", "PURCHASE", 1, 110), _log(2, 30, "3", "VIEW", 2, 90)])
    _write(os.path.join(src, "b.json"), [_log(3, 20, "2", "VIEW", 2, 100)])
    _write(os.path.join(src, "bad.json"), "not json")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    first = INC.run_incremental(spark, src, base, out, ck, n_files=1, price_stats=stats, multiline=True,
                                compact_every=0)
    got = {(r["user_idx"], r["item_idx"]): r["weight"] for r in first.collect()}
    assert got == {("1", 10): 5.0, ("2", 20): 1.0, ("3", 30): 1.0}
    assert spark.read.json(f"{out}/quarantine").where("unparsed is not null").count() == 1   # the bad file is kept
    # rerun: nothing new, nothing changes
    again = INC.run_incremental(spark, src, base, out, ck, n_files=1, price_stats=stats, multiline=True,
                                compact_every=0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    # one added file -> one new batch; final table equals the one-shot merge of everything
    _write(os.path.join(src, "c.json"), [_log(4, 20, "2", "CLICK", 2, 100)])
    final = INC.run_incremental(spark, src, base, out, ck, n_files=1, price_stats=stats, multiline=True,
                                compact_every=1)
    assert INC.live_deltas(spark, out) == 0                      # folded into a new base version
    logs = spark.read.schema(S.LOG_SCHEMA).option("multiLine", True).json(
        [os.path.join(src, f) for f in ("a.json", "b.json", "c.json")])
    one_shot = P.merge(base, P.logs_to_training(logs, price_mode="zscore", price_stats=stats))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, one_shot.collect()))


def test_batches_of_any_size_and_update_job(spark, tmp_dir):
    import pytest
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    base = spark.createDataFrame([(1, 10, 1, 3.0, 0.1, 1)],
                                 "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    stats = spark.createDataFrame([(100.0, 10.0, 100.0)], "mean DOUBLE, std DOUBLE, var DOUBLE")
    for i, price in enumerate((50, 100, 170)):
        _write(os.path.join(src, f"{i}.json"), [_log(i, 10 + i, "newUser", "VIEW", 1, price), _log(i, 10, None, "VIEW", 1, price)])
    tables = [sorted(map(tuple, INC.run_incremental(spark, src, base, f"{tmp_dir}/o{n}", f"{tmp_dir}/c{n}", n_files=n, price_stats=stats).collect()))
              for n in (1, 10)]
    assert tables[0] == tables[1] and len(tables[0]) == 4
    with pytest.raises(ValueError):
        INC.run_incremental(spark, src, base, f"{tmp_dir}/x", f"{tmp_dir}/y")
    trained = []
    comparison, after = INC.update_job(spark, src, base, f"{tmp_dir}/job", f"{tmp_dir}/jobc", stats, retrain=lambda t: trained.append(t.count()))
    delta = {r["statistic"]: r["delta"] for r in comparison.collect()}
    assert trained == [4] and after.count() == 4 and delta["n_records"] == 3.0
    again, _ = INC.update_job(spark, src, base, f"{tmp_dir}/job", f"{tmp_dir}/jobc", stats, retrain=lambda t: trained.append(0))
    assert again is None and trained == [4]                       # nothing new: no comparison, no training


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) >= {"category_idx", "rank", "item_idx", "popularity_score"}
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


def test_request_table_paging(spark):
    """20 available and 20 ranked, top 10: rank 1 -> 1..10 has_next; rank 11 -> 11..20, no next;
    an empty list is an error row."""
    from marmot.plans import serve as SV
    items = list(range(20))
    req = spark.createDataFrame([(1, 5, 10, None, items, 1), (2, 5, 10, None, items, 11), (3, 5, 10, None, [], None)],
                                S.REQUEST_SCHEMA)
    train = spark.createDataFrame([(u, i, 1, float(1 + (i % 3)), 0.0, 1) for u in (100, 101) for i in items],
                                  "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    vec = spark.createDataFrame([(i, [1.0]) for i in items], "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    uvec = spark.createDataFrame([(100, [1.0])], "user_id BIGINT, embedding ARRAY<DOUBLE>")
    out = SV.recommend(req, train, uvec, vec, lambda c: c.withColumn("ranker_score", F.lit(0.5))).collect()
    r1 = sorted(r["rank"] for r in out if r["request_id"] == 1)
    r2 = sorted(r["rank"] for r in out if r["request_id"] == 2)
    assert r1 == list(range(1, 11)) and r2 == list(range(11, 21))
    assert {r["has_next"] for r in out if r["request_id"] == 1} == {True}
    assert {r["has_next"] for r in out if r["request_id"] == 2} == {False}
    assert [r["status"] for r in out if r["request_id"] == 3] == ["error: available_items is required"]


def test_known_user_without_a_vector_gets_popular_items(spark):
    from marmot.plans import serve as SV
    items = [1, 2, 3]
    req = spark.createDataFrame([(1, 5, 2, None, items, None), (2, 100, 2, None, items, None)], S.REQUEST_SCHEMA)
    train = spark.createDataFrame([(u, i, 1, float(i), 0.0, 1) for u in (100, 5) for i in items],
                                  "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    vec = spark.createDataFrame([(i, [1.0]) for i in items], "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    uvec = spark.createDataFrame([(100, [1.0])], "user_id BIGINT, embedding ARRAY<DOUBLE>")
    out = SV.recommend(req, train, uvec, vec, lambda c: c.withColumn("ranker_score", F.lit(0.5))).collect()
    assert sorted((r["rank"], r["item_id"]) for r in out if r["request_id"] == 1) == [(1, 3), (2, 2)]
