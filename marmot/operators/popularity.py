"""Popularity operators: weight sum, interaction count, composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators.prepare import filter_available, filter_category


def _top(df: DataFrame, score: str, k: int | None, item: str) -> DataFrame:
    """Global top-k with a deterministic tie-break (k is bounded: TakeOrderedAndProject)."""
    ranked = df.orderBy(F.col(score).desc(), F.col(item))
    return ranked.limit(k) if k else ranked


def weight_sum(df: DataFrame, k: int | None = None, category: int | None = None,
               item: str = "item_idx", weight: str = "weight") -> DataFrame:
    """sum(weight) per item (optionally of one category), top k by sum desc."""
    agg = (filter_category(df, category).where(F.col(item).isNotNull())
           .groupBy(item).agg(F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias("weight_sum")))
    return _top(agg, "weight_sum", k, item)


def counts(df: DataFrame, k: int | None = None, item: str = "item_idx") -> DataFrame:
    """Interaction count per item, top k."""
    agg = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n_interactions"))
    return _top(agg, "n_interactions", k, item)


def composite_scores(df: DataFrame, item: str = "item_idx", user: str = "user_idx",
                     weight: str = "weight", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per item: 0.7 * sum(w)/max_items(sum(w)) + 0.3 * users/max_items(users).

    Maxima are over *all* items (before any availability or category filter).
    The per-item aggregate combines map-side; the two maxima are scalar
    subqueries over the (one row per item) aggregate.
    """
    w_share, u_share = S.POPULARITY_WEIGHTS
    extra = [F.min(c).alias(c) for c in carry if c in df.columns]
    per_item = (df.where(F.col(item).isNotNull())
                  .groupBy(item).agg(F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias("weight_sum"),
                                     F.countDistinct(user).alias("n_users"), *extra))
    # both maxima in one scalar subquery (evaluated once, shipped as a literal)
    mx = per_item.select(F.struct(F.max("weight_sum").alias("w"),
                                  F.max("n_users").cast("double").alias("u"))).scalar()
    max_w, max_u = mx.getField("w"), mx.getField("u")
    score = F.lit(w_share) * (F.col("weight_sum") / max_w) + F.lit(u_share) * (F.col("n_users") / max_u)
    return per_item.withColumn("popularity_score", score)


def composite(df: DataFrame, n: int = S.DEFAULT_TOP_N, category: int | None = None, available=None,
              meta: DataFrame | None = None, item: str = "item_idx") -> DataFrame:
    """Top-n composite popularity with optional availability and category filters; rank 1..n.

    The category filter keeps items whose (one-row-per-item) meta has that
    category; ``meta`` defaults to the interaction table's own item meta.
    """
    from marmot.operators.prepare import item_meta as _meta
    scored = composite_scores(df, item=item)
    scored = filter_available(scored, available, item)
    if category is not None:
        m = (meta if meta is not None else _meta(df, item))
        cat_items = filter_category(m, category).select(F.col(item).alias("_ci"))
        scored = scored.join(cat_items, scored[item] == cat_items["_ci"], "left_semi")
    top = _top(scored, "popularity_score", n, item)
    w = Window.orderBy(F.col("popularity_score").desc(), F.col(item))
    # n is bounded (<= 100 when serving), so the rank window runs over n rows only
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def composite_per_group(df: DataFrame, n: int, group: str = "category_idx", meta: DataFrame | None = None,
                        item: str = "item_idx") -> DataFrame:
    """Top-n composite popularity within every group (e.g. every category) at once.

    A window partitioned by the group with ``row_number() <= n`` lets Spark
    insert a WindowGroupLimit, so only n rows per group and partition reach
    the final window.
    """
    if meta is None:
        # the item's group rides along in the same aggregation (one row per item, H9: min)
        scored = composite_scores(df, item=item, carry=(group,))
    else:
        scored = composite_scores(df, item=item).join(meta.select(item, group), item)
    w = Window.partitionBy(group).orderBy(F.col("popularity_score").desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)
