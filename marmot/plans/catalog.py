"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them) in full.
Output columns are aliased exactly like the oracle SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.functions import columns as C
from marmot.operators import candidates as CA
from marmot.operators import content as CB
from marmot.operators import metrics as M
from marmot.operators import popularity as POP
from marmot.operators import ranker as RK
from marmot.operators import sample as SA
from marmot.operators import prepare as P
from marmot.operators import split as SP
from marmot.operators import stats as ST
from marmot.plans import etl as ETL
from marmot.plans import serve as SV
from marmot.plans import train as TR
from marmot.session import exists, scratch_path
from marmot.sources import files as FS
from marmot.streaming import bucketed as BK
from marmot.streaming import incremental as INC
from marmot.streaming import live as LV
from marmot.sources import testdata as TD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --------------------------------------------------------------------------- shared derived tables
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal split of the event-derived training rows (written once, read back)."""
    return ETL.splits(spark, sf_dir)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ETL.split_part(spark, sf_dir, "train")


def val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ETL.split_part(spark, sf_dir, "val")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ETL.split_part(spark, sf_dir, "test")


# --------------------------------------------------------------------------- popularity (flagship)
@query("popularity_composite")
def q_popularity_composite(spark, sf_dir):
    t = train(spark, sf_dir)
    out = POP.composite_per_group(t, 10, "category_idx")
    return out.select("category_idx", "rank", "item_idx", "weight_sum", "n_users",
                      C.round6("popularity_score").alias("popularity_score"))


def d4(df: DataFrame) -> DataFrame:
    """The six training columns with price_norm rounded for comparison."""
    return df.select("user_idx", "item_idx", "label", "weight", C.round6("price_norm").alias("price_norm"),
                     "category_idx")


# --------------------------------------------------------------------------- 2.2 scalar / projection operators
@query("enrich_events")
def q_enrich_events(spark, sf_dir):
    df = P.enrich(TD.events(spark, sf_dir), TD.items(spark, sf_dir), how="left")
    return df.select("event_id", "user_id", "item_id", "action", "price", "title", "category_idx")


@query("action_weight")
def q_action_weight(spark, sf_dir):
    df = P.with_action_weight(TD.logs(spark, sf_dir))  # log vocabulary, unknown -> 1.0
    return df.select("event_id", "action", "weight")


@query("action_label")
def q_action_label(spark, sf_dir):
    df = P.with_action_label(TD.events(spark, sf_dir), S.EVENTS_ACTION_WEIGHTS)
    return df.select("event_id", "action", "label")


@query("cast_ids")
def q_cast_ids(spark, sf_dir):
    e = TD.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").alias("item_id"))
    return P.cast_ids(e, user_type="string", item_type="bigint")


@query("clip_category")
def q_clip_category(spark, sf_dir):
    # a 0-based category code (the older label-encoded form) clipped into 1..6
    df = TD.interactions(spark, sf_dir).select("event_id", (F.col("category_idx") - 1).alias("category_raw"))
    return P.clip_category(df, "category_raw", "category_idx")


@query("minmax_price")
def q_minmax_price(spark, sf_dir):
    df = P.minmax(TD.logs(spark, sf_dir), "price", "price_norm")
    return df.select("event_id", C.round6("price_norm").alias("price_norm"))


@query("zscore_price")
def q_zscore_price(spark, sf_dir):
    df = TD.training_rows(spark, sf_dir)
    return df.select("event_id", C.round6("price_norm").alias("price_norm"))


@query("label_encode")
def q_label_encode(spark, sf_dir):
    ev = TD.events(spark, sf_dir)
    users = P.fit_dim(ev, "user_id", "lexicographic").select(F.lit("user").alias("kind"), "id", "idx")
    items = P.fit_dim(ev, "item_id", "lexicographic").select(F.lit("item").alias("kind"), "id", "idx")
    return users.unionByName(items)


@query("dense_encode")
def q_dense_encode(spark, sf_dir):
    dim = P.fit_dim(TD.order_interactions(spark, sf_dir), "item_idx", "natural")
    return dim.select(F.col("id").alias("item_idx"), F.col("idx").alias("item_code"))


@query("decode_category")
def q_decode_category(spark, sf_dir):
    df = P.decode_category(TD.interactions(spark, sf_dir).select("event_id", "category_idx"))
    return df.select("event_id", "category_idx", "category_name")


@query("project_training_columns")
def q_project_training_columns(spark, sf_dir):
    return d4(P.logs_to_training(TD.logs(spark, sf_dir)))


@query("string_user_logs")
def q_string_user_logs(spark, sf_dir):
    """Logs whose user ids are no numbers, one in 97 of them missing: training rows of the others."""
    u = F.when(F.col("user_id").cast("bigint") % 97 != 0, F.concat(F.lit("user_"), "user_id"))
    return d4(P.logs_to_training(TD.logs(spark, sf_dir).withColumn("user_id", u)))


@query("logs_without_ids")
def q_logs_without_ids(spark, sf_dir):
    """What of the same logs goes to the quarantine."""
    u = F.when(F.col("user_id").cast("bigint") % 97 != 0, F.concat(F.lit("user_"), "user_id"))
    bad = P.rows_without_ids(TD.logs(spark, sf_dir).withColumn("user_id", u))
    return bad.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("validate_columns")
def q_validate_columns(spark, sf_dir):
    logs = P.validate_columns(TD.logs(spark, sf_dir), S.LOG_COLUMNS)
    return logs.select(*S.LOG_COLUMNS)


@query("filter_category")
def q_filter_category(spark, sf_dir):
    return d4(P.filter_category(train(spark, sf_dir), 3))


@query("filter_active_users")
def q_filter_active_users(spark, sf_dir):
    return SP.active_users(TD.order_interactions(spark, sf_dir), "user_idx", 3) \
        .groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------------- 2.4 aggregations
@query("popularity_weight_sum")
def q_popularity_weight_sum(spark, sf_dir):
    return POP.weight_sum(train(spark, sf_dir), 20)


@query("popularity_weight_sum_category")
def q_popularity_weight_sum_category(spark, sf_dir):
    return POP.weight_sum(train(spark, sf_dir), 10, category=2)


@query("popularity_count")
def q_popularity_count(spark, sf_dir):
    history = val(spark, sf_dir).unionByName(test(spark, sf_dir))
    return POP.counts(history, 20)


@query("user_item_sets")
def q_user_item_sets(spark, sf_dir):
    # the set of a user is a relation (user, item, multiplicity), never one giant array
    return train(spark, sf_dir).groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_stats")
def q_dataset_stats(spark, sf_dir):
    st = ST.dataset_stats(splits(spark, sf_dir), by="split")
    return st.withColumn("avg_weight", C.round6("avg_weight"))


@query("system_stats")
def q_system_stats(spark, sf_dir):
    return ST.system_stats(train(spark, sf_dir))


@query("category_distribution")
def q_category_distribution(spark, sf_dir):
    out = ST.category_distribution(splits(spark, sf_dir), by="split")
    return out.select("split", "category_idx", "n_rows", C.round6("share").alias("share"))


@query("model_stats")
def q_model_stats(spark, sf_dir):
    # the model of the training rows beside the whole split table
    return ST.model_stats(RK.fit_mf(_model_rows(spark, sf_dir), rank=MODEL_RANK), splits(spark, sf_dir))


@query("compare_before_after")
def q_compare_before_after(spark, sf_dir):
    before = train(spark, sf_dir).select(*S.TRAINING_COLUMNS)
    after = P.merge(before, val(spark, sf_dir).select(*S.TRAINING_COLUMNS))
    out = ST.compare_before_after(before, after)
    return out.select("statistic", *[C.round6(c).alias(c) for c in ("before", "after", "delta")])


@query("value_distribution")
def q_value_distribution(spark, sf_dir):
    return ST.value_distribution(TD.events(spark, sf_dir), "action") \
        .unionByName(ST.value_distribution(train(spark, sf_dir), "category_idx"))


@query("item_attributes")
def q_item_attributes(spark, sf_dir):
    df = P.item_attributes(train(spark, sf_dir))
    return df.select("item_idx", C.round6("price_norm").alias("price_norm"), "category_idx")


@query("dedup_max_weight")
def q_dedup_max_weight(spark, sf_dir):
    return d4(P.dedup_max_weight(train(spark, sf_dir).select(*S.TRAINING_COLUMNS)))


@query("distinct_item_meta")
def q_distinct_item_meta(spark, sf_dir):
    df = P.distinct_item_meta(train(spark, sf_dir))
    return df.select("item_idx", "category_idx", C.round6("price_norm").alias("price_norm"))


@query("time_quantiles")
def q_time_quantiles(spark, sf_dir):
    q = SP.time_quantiles(TD.training_rows(spark, sf_dir))
    return q.select(F.col("q0").alias("q70_us"), F.col("q1").alias("q85_us"))


# --------------------------------------------------------------------------- 2.5 splits / set operations
@query("temporal_split")
def q_temporal_split(spark, sf_dir):
    return splits(spark, sf_dir).select("event_id", "split")


@query("random_split")
def q_random_split(spark, sf_dir):
    pairs = P.dedup_max_weight(TD.training_rows(spark, sf_dir).select(*S.TRAINING_COLUMNS))
    return SP.random_split(pairs, seed=42).select("user_idx", "item_idx", "split")


@query("merge_new_data")
def q_merge_new_data(spark, sf_dir):
    existing = train(spark, sf_dir).select(*S.TRAINING_COLUMNS)
    # both sides on the stored price statistics (H4)
    new = P.logs_to_training(TD.logs(spark, sf_dir), price_mode="zscore", price_stats=TD.price_stats(spark, sf_dir))
    return d4(P.merge(existing, new, deduplicate=True))


@query("union_splits")
def q_union_splits(spark, sf_dir):
    h = val(spark, sf_dir).unionByName(test(spark, sf_dir))
    return h.select("event_id", "user_idx", "item_idx", "split")


@query("sort_by_time")
def q_sort_by_time(spark, sf_dir):
    from marmot.functions.index import global_index
    ev = TD.events(spark, sf_dir).select("event_id", C.ts_micros("ts").alias("ts_us"))
    return global_index(ev, ["ts_us", "event_id"], "position")


# --------------------------------------------------------------------------- 2.3 / 2.6 candidates, ranking, serving
def _requests(spark, sf_dir):
    return TD.requests(spark, sf_dir)


def catalog_train(spark, sf_dir):
    """Training rows over the whole item table (written once, read back)."""
    return ETL.materialized(spark, "catalog-rows", sf_dir, lambda: TD.catalog_interactions(spark, sf_dir))


def _known_items(spark, sf_dir):
    """(request, available item) rows of requests whose user is in the catalogue's training rows."""
    t = catalog_train(spark, sf_dir)
    return CA.request_items(SV.route(_requests(spark, sf_dir), t)).where("known")


def _known_requests(spark, sf_dir):
    """The same requests with their lists, which the first stage scores as lists."""
    return SV.route(_requests(spark, sf_dir), catalog_train(spark, sf_dir)).where("known")


def _vectors(spark, sf_dir, users: DataFrame):
    return (TD.user_vectors(spark, sf_dir, users, "user_id").withColumnRenamed("user_vec", "embedding"),
            TD.catalog_vectors(spark, sf_dir))


@query("filter_available_items")
def q_filter_available_items(spark, sf_dir):
    items = CA.request_items(_requests(spark, sf_dir))
    catalog = catalog_train(spark, sf_dir).select("item_idx").distinct()
    return P.filter_available(catalog, items.select("item_idx")).join(
        items.select("request_id", "item_idx").hint("merge"), "item_idx").select("request_id", "item_idx")


@query("exclude_purchased")
def q_exclude_purchased(spark, sf_dir):
    c = _known_items(spark, sf_dir).select("request_id", F.col("user_id").alias("user_idx"), "item_idx")
    return CA.exclude_purchased(c, catalog_train(spark, sf_dir)).select("request_id", "item_idx")


@query("exclude_seen")
def q_exclude_seen(spark, sf_dir):
    c = _known_items(spark, sf_dir).select("request_id", F.col("user_id").alias("user_idx"), "item_idx")
    return CA.exclude_seen(c, catalog_train(spark, sf_dir)).select("request_id", "item_idx")


@query("user_item_scores")
def q_user_item_scores(spark, sf_dir):
    c = _known_requests(spark, sf_dir)
    uv, iv = _vectors(spark, sf_dir, c)
    s = CA.score_pairs(c, uv.withColumnRenamed("user_id", "user_id"), iv, user="user_id")
    return s.select("request_id", "item_idx", C.round6("score").alias("score"))


@query("mf_top_k")
def q_mf_top_k(spark, sf_dir):
    # users the model does not know get the weight-sum list of their category
    t = catalog_train(spark, sf_dir)
    routed = SV.route(_requests(spark, sf_dir), t)
    uv, iv = _vectors(spark, sf_dir, routed)
    top = CA.mf_candidates(routed, t, uv, iv)
    return top.select("request_id", "item_idx", C.round6("mf_score").alias("mf_score"), "mf_rank")


@query("lookup_item_meta")
def q_lookup_item_meta(spark, sf_dir):
    c = _known_requests(spark, sf_dir)
    uv, iv = _vectors(spark, sf_dir, c)
    t = catalog_train(spark, sf_dir)
    top = CA.mf_top_k(c, t, uv, iv, k=S.CANDIDATE_K, attach=P.item_meta(t))
    return top.select("request_id", "item_idx", "category_idx", C.round6("price_norm").alias("price_norm"))


@query("lookup_mf_score")
def q_lookup_mf_score(spark, sf_dir):
    # ranker candidates = every scorable available item; first-stage scores only for the top 10
    c = _known_requests(spark, sf_dir)
    uv, iv = _vectors(spark, sf_dir, c)
    t = catalog_train(spark, sf_dir)
    full = CA.mf_top_k(c, t, uv, iv, k=S.CANDIDATE_K)
    # the top 10 is a prefix of the top 250 under the same order: one candidate pass
    out = full.select("request_id", "item_idx",
                      F.when(F.col("mf_rank") <= 10, F.col("mf_score")).alias("mf_score"))
    return out.select("request_id", "item_idx", C.round6(F.coalesce("mf_score", F.lit(0.0))).alias("mf_score"))


@query("route_known_users")
def q_route_known_users(spark, sf_dir):
    return SV.route(_requests(spark, sf_dir), catalog_train(spark, sf_dir)).select("request_id", "user_id", "known")


@query("uninteracted_items")
def q_uninteracted_items(spark, sf_dir):
    # per user |catalog| - |own items|: the size of the complement, without emitting it
    t = train(spark, sf_dir)
    n_items = t.select(F.countDistinct("item_idx")).scalar()
    per_user = t.groupBy("user_idx").agg(F.countDistinct("item_idx").alias("_own"))
    return per_user.select("user_idx", (n_items - F.col("_own")).alias("n_uninteracted"))


@query("hybrid_recommend")
def q_hybrid_recommend(spark, sf_dir):
    c = _known_requests(spark, sf_dir)
    uv, iv = _vectors(spark, sf_dir, c)
    out = SV.hybrid(c, catalog_train(spark, sf_dir), uv, iv, TD.given_ranker)
    return out.select("request_id", "item_idx", "position", C.round6("ranker_score").alias("ranker_score"),
                      C.round6("mf_score").alias("mf_score"), C.round6("final_score").alias("final_score"))


@query("rerank")
def q_rerank(spark, sf_dir):
    c = _known_requests(spark, sf_dir)
    uv, iv = _vectors(spark, sf_dir, c)
    t = catalog_train(spark, sf_dir)
    cands = CA.mf_top_k(c, t, uv, iv, attach=P.item_meta(t), by_request=True)
    r = CA.top_k(TD.given_ranker(cands), S.CANDIDATE_K, "request_id", "ranker_score", "item_idx", "position")
    return r.select("request_id", "item_idx", "position", C.round6("ranker_score").alias("ranker_score"))


@query("popularity_per_request")
def q_popularity_per_request(spark, sf_dir):
    items = CA.request_items(SV.route(_requests(spark, sf_dir), catalog_train(spark, sf_dir))).where(~F.col("known"))
    out = SV.popular(items, catalog_train(spark, sf_dir))
    return out.select("request_id", "item_idx", "position", C.round6("popularity_score").alias("popularity_score"))


def _serve_inputs(spark, sf_dir):
    t = catalog_train(spark, sf_dir)
    r = _requests(spark, sf_dir)
    return r, t, TD.user_vectors(spark, sf_dir, r, "user_id").withColumnRenamed("user_vec", "embedding"), \
        TD.catalog_vectors(spark, sf_dir)


@query("recommend_batch")
def q_recommend_batch(spark, sf_dir):
    r, t, uv, iv = _serve_inputs(spark, sf_dir)
    return SV.recommend(r, t, uv, iv, TD.given_ranker)


@query("paginate")
def q_paginate(spark, sf_dir):
    r, t, uv, iv = _serve_inputs(spark, sf_dir)
    return SV.recommend(r, t, uv, iv, TD.given_ranker).select("request_id", "rank", "item_id", "has_next")


@query("simplify_response")
def q_simplify_response(spark, sf_dir):
    top = POP.composite(train(spark, sf_dir), 50)
    return SV.simplify(top, "popularity_score")


@query("content_based")
def q_content_based(spark, sf_dir):
    history = val(spark, sf_dir).unionByName(test(spark, sf_dir))
    users = TD.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_idx"))
    vecs = TD.item_vectors(spark, sf_dir).join(TD.items(spark, sf_dir).select(F.col("item_id").alias("item_idx")),
                                               "item_idx", "left_semi")
    out = CB.similar_items(history, vecs, users, n=5)
    return out.select("user_idx", "rank", "item_idx", C.round6("score").alias("score"), "reason")


@query("user_profile_vector")
def q_user_profile_vector(spark, sf_dir):
    history = val(spark, sf_dir).unionByName(test(spark, sf_dir))
    prof = CB.profiles(history, TD.item_vectors(spark, sf_dir))
    return prof.select("user_idx", F.posexplode("profile").alias("d", "v")).select(
        "user_idx", F.col("d").cast("int").alias("d"), C.round6("v").alias("v"))


# --------------------------------------------------------------------------- 2.7 metrics on given rankings
def _given_rankings(spark, sf_dir):
    """Composite-popularity top 20 of train, as the ranking of every val user."""
    t = train(spark, sf_dir)
    users = val(spark, sf_dir).select("user_idx").distinct()
    top = POP.composite(t, 20).select("item_idx", F.col("popularity_score").alias("score"))
    return CB.attach_list(users, top, "item_idx", "popular_item")


def _per_user(spark, sf_dir, metric, k=10):
    per = M.at_k(_given_rankings(spark, sf_dir), val(spark, sf_dir), ks=(k,))
    return per.select("user_idx", C.round6(metric).alias(metric))


@query("precision_at_k")
def q_precision_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir, "precision")


@query("recall_at_k")
def q_recall_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir, "recall")


@query("dcg_at_k")
def q_dcg_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir, "dcg")


@query("ndcg_at_k")
def q_ndcg_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir, "ndcg")


@query("hit_rate_at_k")
def q_hit_rate_at_k(spark, sf_dir):
    return _per_user(spark, sf_dir, "hit_rate")


@query("evaluate")
def q_evaluate(spark, sf_dir):
    ev = M.evaluate(_given_rankings(spark, sf_dir), val(spark, sf_dir))
    return ev.select("k", *[C.round6(m).alias(m) for m in ("precision", "recall", "ndcg", "hit_rate")],
                     "evaluated_users", "total_users")


# --------------------------------------------------------------------------- 2.1 sources and sinks (derived files)
_FILES: dict[tuple, str] = {}

def _day():
    return F.date_format(C.epoch_ms_to_ts("timestamp"), "yyyy-MM-dd")


LEDGER_UNTIL = "2024-01-05"  # files of days up to this one are marked processed in the fixtures
RANGE_START_MS, RANGE_END_MS = 1704844800000, 1705363199999  # 2024-01-10 00:00 .. 2024-01-15 23:59:59.999 UTC


def _memo_path(spark, sf_dir, key, build) -> str:
    memo = (spark.sparkContext.applicationId, sf_dir, key)
    if memo not in _FILES or not exists(spark, _FILES[memo]):  # rebuild if the files are gone
        _FILES[memo] = build()
    return _FILES[memo]


def log_files(spark, sf_dir) -> str:
    """The event log written as JSON files, one directory (and file) per day."""
    def build():
        path = scratch_path(spark, "logs")
        logs = TD.logs(spark, sf_dir).drop("event_id").withColumn("day", _day())
        return FS.write_logs_json(logs.repartition("day"), path, ["day"])
    return _memo_path(spark, sf_dir, "logs", build)


def array_files(spark, sf_dir) -> str:
    """The same log in the live layout: files that are one JSON array each."""
    def build():
        logs = TD.logs(spark, sf_dir).drop("event_id").withColumn("day", _day())
        return FS.write_logs_json(logs, scratch_path(spark, "log-arrays"), ["day"], layout="array")
    return _memo_path(spark, sf_dir, "log-arrays", build)


def ledger(spark, sf_dir) -> str:
    """A ledger holding the files of the first days."""
    logs_path = log_files(spark, sf_dir)

    def build():
        path = scratch_path(spark, "ledger")
        files = FS.list_log_files(spark, logs_path)
        FS.mark_processed(files.where(F.regexp_extract("file_path", r"day=([0-9-]+)", 1) <= LEDGER_UNTIL), path)
        return path
    return _memo_path(spark, sf_dir, ("ledger", logs_path), build)  # tied to these log files


def _good_logs(spark, sf_dir):
    good, _ = FS.read_logs(spark, log_files(spark, sf_dir), multiline=False)
    return good


@query("read_interactions_csv")
def q_read_interactions_csv(spark, sf_dir):
    path = scratch_path(spark, "splits_csv")
    FS.write_splits(splits(spark, sf_dir).select(*S.TRAINING_COLUMNS, "split"), path, "csv")
    back = FS.read_interactions(spark, path)  # split comes back from the directory layout
    return back.select(*S.TRAINING_COLUMNS, "split").withColumn("price_norm", C.round6("price_norm"))


@query("write_splits")
def q_write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits_parquet")
    FS.write_splits(splits(spark, sf_dir).select(*S.TRAINING_COLUMNS, "split"), path, "parquet")
    return FS.read_interactions(spark, path, fmt="parquet").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("read_json_logs")
def q_read_json_logs(spark, sf_dir):
    good, _ = FS.read_logs(spark, array_files(spark, sf_dir), ext=".txt")
    return good.select(*S.LOG_COLUMNS)


@query("read_json_lines")
def q_read_json_lines(spark, sf_dir):
    return _good_logs(spark, sf_dir).select(*S.LOG_COLUMNS)


@query("write_logs_json")
def q_write_logs_json(spark, sf_dir):
    # whole rows, read back beside the day of the folder that holds them
    path = FS.write_logs_json(TD.logs(spark, sf_dir).drop("event_id").withColumn("day", _day()), scratch_path(spark, "log-arrays"), ["day"],
                              layout="array", rows_per_file=500)
    good, _ = FS.read_logs(spark, path, ext=".txt")
    return good.select(F.regexp_extract("file_path", r"day=([0-9-]+)", 1).alias("day"), *S.LOG_COLUMNS)


@query("discover_log_files")
def q_discover_log_files(spark, sf_dir):
    files = FS.list_log_files(spark, log_files(spark, sf_dir), prefix="day=2024-01")
    return files.groupBy(F.regexp_extract("file_path", r"day=([0-9-]+)", 1).alias("day")).agg(
        F.count(F.lit(1)).alias("n_files"))


@query("skip_processed")
def q_skip_processed(spark, sf_dir):
    led = FS.load_ledger(spark, ledger(spark, sf_dir))
    # the processed files are left out by name, before any is opened
    good, _ = FS.read_log_files(FS.unprocessed(FS.list_log_files(spark, log_files(spark, sf_dir)), led), multiline=False)
    return good.select(*S.LOG_COLUMNS)


@query("file_states")
def q_file_states(spark, sf_dir):
    """The ledger after a second run that tried every file again: attempts and state by day."""
    src = log_files(spark, sf_dir)
    led = scratch_path(spark, "ledger-states")
    files = FS.list_log_files(spark, src)
    day = F.regexp_extract("file_path", r"day=([0-9-]+)", 1)
    FS.record(files.select("file_path", F.when(day <= LEDGER_UNTIL, FS.DONE).otherwise(FS.FAILED).alias("state")), led)
    again = FS.unprocessed(files, FS.load_ledger(spark, led))
    good, bad = FS.read_log_files(again, multiline=False)
    FS.record(FS.outcome(again, good, bad), led)
    return FS.file_states(FS.load_ledger(spark, led)).select(day.alias("day"), "state", "attempts")


@query("latest_unprocessed_files")
def q_latest_unprocessed_files(spark, sf_dir):
    led = FS.load_ledger(spark, ledger(spark, sf_dir))
    rows, _ = FS.fetch_latest_logs(spark, log_files(spark, sf_dir), led, 10, multiline=False)
    return rows.select(*S.LOG_COLUMNS)


@query("logs_by_date_range")
def q_logs_by_date_range(spark, sf_dir):
    led = FS.load_ledger(spark, ledger(spark, sf_dir))
    rows, _ = FS.fetch_logs_by_date(spark, log_files(spark, sf_dir), led, RANGE_START_MS, RANGE_END_MS,
                                    multiline=False, day_folders=True)
    return rows.select(*S.LOG_COLUMNS)


@query("filter_by_timestamp")
def q_filter_by_timestamp(spark, sf_dir):
    return FS.filter_by_timestamp(TD.logs(spark, sf_dir), RANGE_START_MS, RANGE_END_MS).select("event_id", "timestamp")


@query("snapshot_before_overwrite")
def q_snapshot_before_overwrite(spark, sf_dir):
    base = scratch_path(spark, "snapshots")
    FS.write_snapshot(train(spark, sf_dir).select(*S.TRAINING_COLUMNS), base, "v1")
    merged = P.merge(FS.read_snapshot(spark, base, "v1"), val(spark, sf_dir).select(*S.TRAINING_COLUMNS))
    FS.write_snapshot(merged, base, "v2")  # v1 stays as the backup
    return d4(FS.read_snapshot(spark, base))


@query("write_encoders")
def q_write_encoders(spark, sf_dir):
    rows = TD.training_rows(spark, sf_dir)
    path = scratch_path(spark, "encoders")
    FS.write_encoders(path, P.fit_dim(rows, "user_idx"), P.fit_dim(rows, "item_idx"),
                      P.category_dim(spark), TD.price_stats(spark, sf_dir))
    enc = FS.read_encoders(spark, path)
    return enc["user_dim"].select(F.lit("user").alias("kind"), "id", "idx").unionByName(
        enc["item_dim"].select(F.lit("item").alias("kind"), "id", "idx"))


@query("read_embeddings")
def q_read_embeddings(spark, sf_dir):
    v = FS.read_embeddings(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return v.select("item_idx", F.size("embedding").alias("n_dims"), C.round6(C.l2_norm("embedding")).alias("norm"))


# --------------------------------------------------------------------------- 2.5 negative sampling
@query("negatives_per_user")
def q_negatives_per_user(spark, sf_dir):
    return SA.negatives_per_user(train(spark, sf_dir).select(*S.TRAINING_COLUMNS), n=5, seed=42)


@query("negatives_per_user_quota")
def q_negatives_per_user_quota(spark, sf_dir):
    neg = SA.negatives_per_user(train(spark, sf_dir).select(*S.TRAINING_COLUMNS), n=5, seed=42)
    return neg.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_negatives"))


@query("negatives_with_attributes")
def q_negatives_with_attributes(spark, sf_dir):
    return d4(SA.negatives_with_attributes(train(spark, sf_dir).select(*S.TRAINING_COLUMNS), n=3, seed=42))


@query("negatives_global_ratio")
def q_negatives_global_ratio(spark, sf_dir):
    out = SA.negatives_global_ratio(train(spark, sf_dir).select(*S.TRAINING_COLUMNS), 0.2, seed=42)
    return out.agg(F.count(F.lit(1)).alias("n_negatives"))


# --------------------------------------------------------------------------- 2.7 models
# The fitted numbers depend on the solver, so the queries return facts of the fitted models that SQL can state.
MODEL_RANK = 50


def _model_rows(spark, sf_dir):
    return train(spark, sf_dir).select(*S.TRAINING_COLUMNS)


@query("fit_mf")
def q_fit_mf(spark, sf_dir):
    t = _model_rows(spark, sf_dir)
    dims = RK.fit_dims(t)
    rated = RK.ratings(t, item_dim=dims[1]).checkpoint(eager=True)  # fitted and tested
    m = RK.fit_mf(t, rank=MODEL_RANK, dims=dims, rated=rated)
    e = m.errors(rated).select(F.struct("n_pairs", (F.col("mse") < F.col("mse_of_mean")).alias("learned"))).scalar()
    return m.user_factors().select("user_idx", F.size("embedding").alias("n_factors"), e.getField("learned").alias("beats_mean"))


@query("fit_nmf")
def q_fit_nmf(spark, sf_dir):
    t = _model_rows(spark, sf_dir)
    m = RK.fit_nonneg_mf(t, rank=MODEL_RANK)
    return m.item_factors().select("item_idx", F.size("embedding").alias("n_factors"),
                                   F.forall("embedding", lambda x: x >= 0).alias("nonnegative"),
                                   F.exists("embedding", lambda x: x > 0).alias("in_use"))


@query("save_load_model")
def q_save_load_model(spark, sf_dir):
    m = RK.fit_mf(_model_rows(spark, sf_dir), rank=MODEL_RANK)
    path = scratch_path(spark, "mf_model")
    m.save(path)
    loaded = RK.MFModel.load(spark, path)
    fitted = m.item_factors().select(F.col("item_idx").alias("_i"), F.col("embedding").alias("_e"))
    both = loaded.item_factors().join(fitted, F.col("item_idx") == F.col("_i"))
    return both.select("item_idx", F.size("embedding").alias("n_factors"), (F.col("embedding") == F.col("_e")).alias("same"))


@query("fit_ranker")
def q_fit_ranker(spark, sf_dir):
    t = _model_rows(spark, sf_dir)
    rk = RK.fit_ranker(t)
    rows = SA.negatives_with_attributes(t, 3, 42)  # the rows it learns from
    scored = rk.score(rows).checkpoint(eager=True)
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("ranker_score")))
    separates = scored.select(mean(1) > mean(0)).scalar()
    return (scored.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_scored"),
                                           F.bool_and((F.col("ranker_score") >= 0) & (F.col("ranker_score") <= 1)).alias("in_range"))
            .withColumn("separates", separates))


def _recommendation_facts(spark, sf_dir, model):
    """Per validation user: recommendations, their last rank, how many of them the user had bought."""
    t = train(spark, sf_dir)
    recs = TR.recommend_all(model, t, val(spark, sf_dir).select("user_idx")).checkpoint(eager=True)
    bought = t.where(F.col("weight") == S.PURCHASE_WEIGHT).select("user_idx", "item_idx", F.lit(1).alias("_b")).distinct()
    return recs.join(bought, ["user_idx", "item_idx"], "left").groupBy("user_idx").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("item_idx").alias("n_distinct"),
        F.max("rank").alias("last_rank"), F.count("_b").alias("n_bought"))


@query("train_hybrid")
def q_train_hybrid(spark, sf_dir):
    return _recommendation_facts(spark, sf_dir, TR.train_hybrid(train(spark, sf_dir), mf_factors=MODEL_RANK))


@query("grid_search")
def q_grid_search(spark, sf_dir):
    return TR.grid_search(train(spark, sf_dir), val(spark, sf_dir), TR.QUICK_GRID)


@query("write_tuning_results")
def q_write_tuning_results(spark, sf_dir):
    grid = {"mf_factors": [8], "epochs": [5], "batch_size": [512], "top_k": [50], "top_n": [10]}
    res = TR.grid_search(train(spark, sf_dir), val(spark, sf_dir), grid)
    path = scratch_path(spark, "tuning")
    res.write.mode("overwrite").option("header", True).csv(f"{path}/all_experiments")
    res.where("is_best").write.mode("overwrite").json(f"{path}/best_params")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/all_experiments")


# --------------------------------------------------------------------------- 2.8 incremental (Structured Streaming)
@query("incremental_update")
def q_incremental_update(spark, sf_dir):
    src = log_files(spark, sf_dir)
    out = scratch_path(spark, "incremental")
    ck = scratch_path(spark, "incremental-ckpt")
    merged = INC.run_incremental(spark, src, train(spark, sf_dir), out, ck, n_files=10, multiline=False,
                                 price_stats=TD.price_stats(spark, sf_dir))
    return d4(merged)


@query("bucketed_update")
def q_bucketed_update(spark, sf_dir):
    root = scratch_path(spark, "bucketed")
    BK.create(spark, root, train(spark, sf_dir), buckets=16)
    while BK.ingest(spark, array_files(spark, sf_dir), root, f"{root}/ledger", TD.price_stats(spark, sf_dir), ext=".txt"):
        pass  # ten files a run until none is new
    return d4(BK.read(spark, root))


@query("update_job")
def q_update_job(spark, sf_dir):
    root = scratch_path(spark, "update-job")
    comparison, _ = BK.update_job(spark, array_files(spark, sf_dir), train(spark, sf_dir), root, f"{root}/ledger", TD.price_stats(spark, sf_dir),
                                  buckets=16, ext=".txt", n_files=10_000)
    return comparison.select("statistic", *[C.round6(c).alias(c) for c in ("before", "after", "delta")])


@query("live_popularity")
def q_live_popularity(spark, sf_dir):
    # validation and test rows arrive as two batches; the state follows by deltas
    root = scratch_path(spark, "live-popularity")
    BK.create(spark, root, train(spark, sf_dir), buckets=16)
    LV.refresh(spark, root)
    for name, rows in (("val", val(spark, sf_dir)), ("test", test(spark, sf_dir))):
        BK.merge_batch(spark, root, rows, name)
        LV.refresh(spark, root)
    return LV.popular_per_category(LV.state(spark, root), 10).select(
        "category_idx", "rank", "item_idx", "weight_sum", "n_users", "n_interactions", C.round6("popularity_score").alias("popularity_score"))


@query("live_statistics")
def q_live_statistics(spark, sf_dir):
    # the log files arrive in one run after the first state; statistics and category distribution in long form
    root = scratch_path(spark, "live-statistics")
    BK.create(spark, root, train(spark, sf_dir), buckets=16)
    LV.refresh(spark, root)
    BK.ingest(spark, array_files(spark, sf_dir), root, f"{root}/ledger", TD.price_stats(spark, sf_dir), ext=".txt", n_files=10_000)
    LV.refresh(spark, root)
    st = LV.state(spark, root)
    shares = LV.category_distribution(st)
    per_category = [shares.select(F.concat(F.lit(f"{name} of category "), F.coalesce(F.col("category_idx").cast("string"), F.lit("none"))).alias("statistic"),
                                  F.col(name).cast("double").alias("value")) for name in ("n_rows", "n_items", "share")]
    out = ST._long(LV.dataset_stats(st)).unionByName(per_category[0]).unionByName(per_category[1]).unionByName(per_category[2])
    return out.select("statistic", C.round6("value").alias("value"))


@query("train_hybrid_mlp")
def q_train_hybrid_mlp(spark, sf_dir):
    return _recommendation_facts(spark, sf_dir, TR.train_hybrid(train(spark, sf_dir), mf_factors=MODEL_RANK, ranker="mlp"))
