"""Batch serving: a request table in, a response table out (one job for all requests).

request -> route (known user?) -> known: MF candidates (k) -> ranker -> blend,
unknown: composite popularity with the request's filters -> first ``depth``
results -> page [rank, rank + top_n) -> response rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators import candidates as CA
from marmot.session import written

Ranker = Callable[[DataFrame], DataFrame]  # adds ``ranker_score`` to candidate rows


def route(requests: DataFrame, interactions: DataFrame, user: str = "user_id",
          known_user: str = "user_idx") -> DataFrame:
    """Flag requests whose user appears in the training interactions.

    Requests carry whole lists that the planner's size estimates leave out, so neither side is broadcast."""
    known = interactions.select(F.col(known_user).alias("_k")).distinct()
    return (requests.join(known.hint("merge"), requests[user] == known["_k"], "left")
                    .withColumn("known", F.col("_k").isNotNull()).drop("_k"))


def item_table(interactions: DataFrame, item: str = "item_idx", user: str = "user_idx") -> DataFrame:
    """Everything serving needs per item, from ONE aggregation of the interactions:
    meta (smallest (category, price_norm) seen, H9), weight sum, distinct users and
    the composite popularity score (maxima over all items)."""
    w_share, u_share = S.POPULARITY_WEIGHTS
    per_item = (interactions.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.min(F.struct("category_idx", "price_norm")).alias("_m"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("weight_sum"),
        F.countDistinct(user).alias("n_users")))
    mx = per_item.select(F.struct(F.max("weight_sum").alias("w"),
                                  F.max("n_users").cast("double").alias("u"))).scalar()
    score = (F.lit(w_share) * (F.col("weight_sum") / mx.getField("w")) +
             F.lit(u_share) * (F.col("n_users") / mx.getField("u")))
    return per_item.select(item, F.col("_m.category_idx").alias("category_idx"),
                           F.col("_m.price_norm").alias("price_norm"), "weight_sum", "n_users",
                           score.alias("popularity_score"))


def blend(df: DataFrame, ranker: str = "ranker_score", mf: str = "mf_score") -> DataFrame:
    """final = 0.6 * ranker + 0.4 * (mf / 10 if mf > 0 else 0); mf defaults to 0.0."""
    m = F.coalesce(F.col(mf), F.lit(0.0))
    return df.withColumn("final_score", F.lit(S.BLEND_RANKER) * F.col(ranker) +
                         F.lit(S.BLEND_MF) * F.when(m > 0, m / S.BLEND_MF_SCALE).otherwise(0.0))


def hybrid(req_items: DataFrame, interactions: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame,
           ranker: Ranker, k: int = S.CANDIDATE_K, depth: int = S.SERVE_DEPTH, exclude_mode: str = "purchased",
           order_by: str = "ranker_score", items: DataFrame | None = None) -> DataFrame:
    """Two-stage ranking per request: MF top k -> attach item meta (items without meta
    drop out; it comes with the candidates) -> ranker score -> blend -> first ``depth`` in ranker order (H8).
    The category filter and the meta both come from the one-row-per-item table, so
    an item is kept only when its meta category is the requested one."""
    items = items if items is not None else item_table(interactions)
    c = CA.mf_top_k(req_items, interactions, user_vecs, item_vecs, k, exclude_mode, items=items,
                    attach=items.select("item_idx", "category_idx", "price_norm"), by_request=True)
    scored = blend(ranker(c))
    return CA.top_k(scored, depth, "request_id", order_by, "item_idx", "position")


def popular(req_items: DataFrame, interactions: DataFrame, depth: int = S.SERVE_DEPTH,
            items: DataFrame | None = None) -> DataFrame:
    """Composite popularity per request (maxima over all items, then the request's
    availability and category filters), first ``depth``.  ``req_items`` are rows of
    ``request_items``, or requests with their lists, which stay lists up to the cut."""
    scores = items if items is not None else item_table(interactions)
    if CA.LIST in req_items.columns:
        return CA.popular_of_lists(req_items, scores, depth)
    c = req_items.join(scores.select("item_idx", "category_idx", "popularity_score").hint("merge"), "item_idx")
    c = c.where(F.col("category_id").isNull() | (F.col("category_id") == F.col("category_idx")))
    return CA.top_k(c, depth, "request_id", "popularity_score", "item_idx", "position")


def paginate(ranked: DataFrame, requests: DataFrame, pos: str = "position") -> DataFrame:
    """Slice [start, start + top_n) of each request's ranked list (start = rank or 1).

    has_next = last returned rank < len(available_items) (H11, kept as in the
    reference); has_more_results compares with the real result count.
    Requests with an empty page still get one row (rank/item null).
    """
    # the ranking is read once; a request's results are one row, its list of available items only a size
    n_res = ranked.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(F.col(pos).alias("_pos"), F.col("item_idx").alias("item_id"))).alias("_page"))
    req = (requests.select("request_id", "user_id", "top_n", "rank", F.size("available_items").alias("_size"))
                   .withColumn("_start", F.coalesce(F.col("rank"), F.lit(1)))
                   .join(n_res.hint("merge"), "request_id", "left")
                   .withColumn("_n", F.coalesce("_n", F.lit(0))))
    page_len = F.least(F.col("top_n"), F.greatest(F.lit(0), F.col("_n") - F.col("_start") + 1))
    req = (req.withColumn("_len", page_len)
              .withColumn("has_next", (F.col("_start") + F.col("_len") - 1) < F.col("_size"))
              .withColumn("has_more_results", (F.col("_start") + F.col("_len") - 1) < F.col("_n")))
    page = F.filter("_page", lambda p: (p["_pos"] >= F.col("_start")) & (p["_pos"] < F.col("_start") + F.col("top_n")))
    out = req.withColumn("_row", F.explode_outer(page))
    return out.select("request_id", "user_id", F.col("_row._pos").cast("int").alias("rank"), F.col("_row.item_id").alias("item_id"),
                      "has_next", "has_more_results")


def recommend(requests: DataFrame, interactions: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame,
              ranker: Ranker, k: int = S.CANDIDATE_K, depth: int = S.SERVE_DEPTH) -> DataFrame:
    """Whole request table -> response rows (request_id, user_id, rank, item_id, has_next,
    has_more_results, status).  Requests without available items get one error row."""
    valid = F.coalesce(F.size("available_items"), F.lit(0)) > 0
    ok = requests.where(valid)
    bad = requests.where(~valid).select(
        "request_id", "user_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("item_id"),
        F.lit(None).cast("boolean").alias("has_next"), F.lit(None).cast("boolean").alias("has_more_results"),
        F.lit("error: available_items is required").alias("status"))
    # Each branch prunes columns differently, so Spark cannot reuse a shared subplan;
    # the routed requests (read by three branches) and the per-item table (one row
    # per item, read by three) are written once to the shared checkpoint folder.
    # A user is served by the model if it has a vector for them; everyone else, known or new, gets popular items.
    in_model = user_vecs.select(F.col(user_vecs.columns[0]).alias("user_idx")).distinct()
    routed = written(route(ok, interactions.select("user_idx").join(in_model, "user_idx", "left_semi")), "routed")
    items = item_table(interactions).checkpoint(eager=True)
    hy = hybrid(routed.where("known"), interactions, user_vecs, item_vecs, ranker, k, depth, items=items)
    po = popular(routed.where(~F.col("known")), interactions, depth, items=items)
    ranked = hy.select("request_id", "item_idx", "position").unionByName(po.select("request_id", "item_idx", "position"))
    return paginate(ranked, routed).withColumn("status", F.lit("ok")).unionByName(bad)


def simplify(items: DataFrame, order: str, item: str = "item_idx", rank: str | None = None,
             by: str | None = None) -> DataFrame:
    """Project (item_id, rank); the rank defaults to the position under ``order``."""
    w = (Window.partitionBy(by) if by else Window).orderBy(F.col(order).desc(), F.col(item))
    r = F.col(rank) if rank and rank in items.columns else F.row_number().over(w)
    keys = [by] if by else []
    return items.select(*keys, F.col(item).alias("item_id"), r.cast("int").alias("rank"))
