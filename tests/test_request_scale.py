"""Serving joins at scale: rows that hold or come from whole item lists never pass the driver."""
from pyspark.sql import functions as F

from marmot.operators import candidates as CA
from marmot.operators import prepare as P
from marmot.plans import serve as SV
from marmot.schemas import INTERACTION_SCHEMA

REQUESTS = "request_id bigint, user_id bigint, top_n int, category_id int, available_items array<bigint>, rank int"


def _tables(spark):
    requests = spark.createDataFrame([(1, 10, 2, None, [1, 2, 3, 2], 1), (2, 11, 2, 5, [3, 4], 1), (3, 99, 2, None, [1, 2], 1)], REQUESTS)
    seen = spark.createDataFrame([("10", 1, 1, 5.0, 0.1, 5), ("10", 2, 1, 1.0, 0.2, 5), ("11", 3, 1, 1.0, 0.3, 5), ("11", 4, 1, 5.0, 0.4, 6)], INTERACTION_SCHEMA)
    return requests, seen.withColumn("user_idx", F.col("user_idx").cast("bigint"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().treeString()


def test_exploded_requests_are_not_broadcast(spark):
    requests, seen = _tables(spark)
    known = CA.request_items(SV.route(requests, seen)).where("known").select("request_id", F.col("user_id").alias("user_idx"), "item_idx")
    for out, rows in ((CA.exclude_purchased(known, seen), [(1, 2), (1, 3), (2, 3)]), (CA.exclude_seen(known, seen), [(1, 3)])):
        assert "Broadcast" not in _plan(out)
        assert sorted((r["request_id"], r["item_idx"]) for r in out.collect()) == rows
    kept = P.filter_available(seen.select("item_idx").distinct(), known.select("item_idx"))
    assert "Broadcast" not in _plan(kept) and sorted(r[0] for r in kept.collect()) == [1, 2, 3, 4]


def _vectors(spark):
    users = spark.createDataFrame([(10, [1.0, 0.5]), (11, [-1.0, 2.0]), (11, [0.5, None])], "user_id bigint, embedding array<float>")
    items = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "item_idx bigint, embedding array<float>")
    return users, items


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lists_score_as_their_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(CA, "LIST_CHUNK", 2)  # several chunks and blocks
    requests, seen = _tables(spark)
    users, items = _vectors(spark)
    for metric in ("dot", "cosine"):
        by_list = CA.score_pairs(requests, users, items, "user_id", metric=metric)
        by_pair = CA.score_pairs(CA.request_items(requests), users, items, "user_id", metric=metric)
        cols = ["request_id", "user_id", "category_id", "item_idx", "score"]
        assert by_list.count() > 5 and _rows(by_list.select(*cols)) == _rows(by_pair.select(*cols))
    assert _plan(by_list).count("Generate explode(arrays_zip") == 1 and "array_distinct" not in _plan(by_list).split("FlatMapCoGroupsInArrow")[0]


def test_candidates_of_lists_and_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(CA, "LIST_CHUNK", 2)
    requests, seen = _tables(spark)
    users, items = _vectors(spark)
    meta = P.item_meta(seen)
    cols = ["request_id", "item_idx", "mf_score", "mf_rank", "category_idx"]
    top = CA.mf_top_k(requests, seen, users, items, k=2, attach=meta).select(*cols)
    # user 10 bought item 1; item 3 has two vectors; request 2 asks for category 5, which item 4 is not in
    # user 11's second vector has a null: no score, last
    assert _rows(top) == sorted([(1, 2, 2.0, 1, 5), (1, 3, 2.0, 2, 5), (2, 3, 2.0, 1, 5), (2, 3, -2.0, 2, 5)], key=repr)
    assert _rows(CA.mf_top_k(CA.request_items(requests), seen, users, items, k=2, attach=meta).select(*cols)) == _rows(top)
    # the pairs are never rows before the cut
    assert "Generate explode(array_distinct" not in _plan(top) and "Broadcast" not in _plan(top)


def test_pages_read_the_ranking_once(spark):
    requests, _ = _tables(spark)
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 5, 1)], "request_id bigint, item_idx bigint, position int").where("item_idx > 0")
    out = SV.paginate(ranked, requests)
    assert _rows(out.select("request_id", "rank", "item_id", "has_next", "has_more_results")) == sorted(
        [(1, 1, 7, True, True), (1, 2, 8, True, True), (2, 1, 5, True, False), (3, None, None, True, False)], key=repr)
    assert _plan(out).count("item_idx > 0") <= 1 or _plan(out).count("Scan ExistingRDD[request_id") == 1


def _families(spark, n=64, families=8):
    """Requests of ``families`` lists that share no item, with vectors of all users and items."""
    requests = spark.createDataFrame([(r, 100 + r, 2, 5 if r % 3 else None, [10 * (r % families) + j for j in range(9, -1, -1)], 1) for r in range(n)], REQUESTS)
    seen = spark.createDataFrame([(str(100 + i % n), i, 1, 5.0 if i % 4 else 2.0, 0.01 * i, 5 if i % 5 else 6) for i in range(10 * families)], INTERACTION_SCHEMA)
    users = spark.createDataFrame([(100 + r, [1.0, 0.1 * r]) for r in range(n)], "user_id bigint, embedding array<float>")
    items = spark.createDataFrame([(i, [0.1 * (i % 7), 1.0 - 0.05 * i]) for i in range(10 * families)], "item_idx bigint, embedding array<float>")
    return requests, seen.withColumn("user_idx", F.col("user_idx").cast("bigint")), users, items


def test_an_item_goes_only_to_blocks_that_ask_for_it(spark, monkeypatch):
    monkeypatch.setattr(CA, "BLOCK_REQUESTS", 4)  # 16 blocks
    requests, seen, users, items = _families(spark)
    cols = ["request_id", "user_id", "item_idx", "mf_score", "mf_rank"]
    near = CA.mf_top_k(requests, seen, users, items, k=3)
    assert "Generate explode(" not in _plan(near)  # one row for every block
    # a request is ranked in the task that scored it
    assert "collect_list" not in _plan(near).split("FlatMapCoGroupsInArrow")[0]
    monkeypatch.setattr(CA, "_items_sent", lambda *a: float("inf"))  # lists without anything in common
    monkeypatch.setattr(CA, "LIST_CHUNK", 16)
    monkeypatch.setattr(CA, "LIST_PAIRS", 50)
    far = CA.mf_top_k(requests, seen, users, items, k=3)
    assert "Generate explode(" in _plan(far)
    pairs = CA.mf_top_k(CA.request_items(requests), seen, users, items, k=3)
    assert len(_rows(near)) > 100 and _rows(near.select(*cols)) == _rows(far.select(*cols)) == _rows(pairs.select(*cols))


def test_rows_of_one_request_id_share_one_ranking(spark):
    requests, seen, users, items = _families(spark, 16)
    requests = requests.withColumn("request_id", F.when(F.col("request_id") < 14, F.floor(F.col("request_id") / 2)).cast("bigint"))
    top = CA.mf_top_k(requests, seen, users, items, k=4)
    ranks = {r["request_id"]: r["n"] for r in top.groupBy("request_id").agg(F.sort_array(F.collect_list("mf_rank")).alias("n")).collect()}
    assert ranks == {k: [1, 2, 3, 4] for k in (*range(7), None)}


def test_popular_items_of_lists_and_of_rows(spark):
    requests, seen, *_ = _families(spark)
    requests = requests.withColumn("user_id", F.when(F.col("request_id") > 3, F.col("user_id")))
    cols = ["request_id", "user_id", "item_idx", "category_idx", "popularity_score", "position"]
    by_list = SV.popular(requests, seen, 4)
    assert "Generate explode(array_distinct" not in _plan(by_list) and "available_items" not in _plan(by_list)
    by_row = SV.popular(CA.request_items(requests), seen, 4)
    assert by_row.count() > 200 and _rows(by_list.select(*cols)) == _rows(by_row.select(*cols))
