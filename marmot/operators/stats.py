"""Dataset and system statistics (one aggregation pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAT_NAMES = ("n_records", "n_users", "n_items", "n_positive", "n_negative", "avg_weight")


def dataset_stats(df: DataFrame, by: str | None = None, user: str = "user_idx", item: str = "item_idx") -> DataFrame:
    """records, distinct users / items, positives, negatives, mean weight (optionally per group)."""
    aggs = [F.count(F.lit(1)).alias("n_records"),
            F.countDistinct(user).alias("n_users"),
            F.countDistinct(item).alias("n_items"),
            F.count_if(F.col("label") == 1).alias("n_positive"),
            F.count_if(F.col("label") == 0).alias("n_negative"),
            F.avg("weight").alias("avg_weight")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def system_stats(df: DataFrame, user: str = "user_idx", item: str = "item_idx",
                 category: str = "category_idx", model_rank: int | None = None) -> DataFrame:
    """train size, distinct users / items / categories (and the model's factor count)."""
    out = df.agg(F.count(F.lit(1)).alias("train_rows"),
                 F.countDistinct(user).alias("n_users"),
                 F.countDistinct(item).alias("n_items"),
                 F.countDistinct(category).alias("n_categories"))
    if model_rank is not None:
        out = out.withColumn("model_rank", F.lit(int(model_rank)))
    return out


def _long(stats: DataFrame, names=STAT_NAMES) -> DataFrame:
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return stats.selectExpr(f"stack({len(names)}, {pairs}) AS (statistic, value)")


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(statistic, before, after, delta) for every dataset statistic."""
    b = _long(dataset_stats(before)).withColumnRenamed("value", "before")
    a = _long(dataset_stats(after)).withColumnRenamed("value", "after")
    return b.join(a, "statistic").withColumn("delta", F.col("after") - F.col("before"))


def value_distribution(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Rows per distinct value of ``col`` as (column_name, value, n)."""
    return (df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit(name or col).alias("column_name"), "value", "n"))


def category_distribution(df: DataFrame, by: str | None = None, category: str = "category_idx") -> DataFrame:
    """Rows and their share per category (optionally within each group); rows without a category are one of them."""
    keys = [by] if by else []
    per = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n_rows"))
    # the totals add up one row per group and category
    total = per.groupBy(*keys).agg(F.sum("n_rows").alias("_total"))
    if by:
        per = per.join(total.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
        return per.select(by, category, "n_rows", (F.col("n_rows") / F.col("_total")).alias("share"))
    return per.withColumn("share", F.col("n_rows") / total.scalar())


def model_stats(model, df: DataFrame, user: str = "user_idx", item: str = "item_idx") -> DataFrame:
    """One row about a factor model and the table it serves: its factors, users and items, and how many of the
    table's users and items it does not know (they get popular items)."""
    def side(factors: DataFrame, column: str) -> DataFrame:
        known = factors.select(F.col(factors.columns[0]).alias("_k"))
        own = df.select(column).where(F.col(column).isNotNull()).distinct().join(known, F.col(column) == F.col("_k"), "full")
        return own.agg(F.count("_k").alias(f"model_{column}"), F.count_if(F.col("_k").isNull()).alias(f"unknown_{column}"))
    # two one-row sides
    users = side(model.user_factors(), user).select(F.struct("*")).scalar()
    items = side(model.item_factors(), item).select(F.struct("*")).scalar()
    one = df.sparkSession.range(1)
    return one.select(F.lit(int(model.rank)).alias("model_rank"), users.getField(f"model_{user}").alias("model_users"),
                      items.getField(f"model_{item}").alias("model_items"), users.getField(f"unknown_{user}").alias("unknown_users"),
                      items.getField(f"unknown_{item}").alias("unknown_items"))
