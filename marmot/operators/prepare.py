"""Feature, label and table preparation operators (DataFrame in, DataFrame out)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.functions import columns as C
from marmot.functions.index import global_index


# --------------------------------------------------------------------------- validation
def validate_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise ``ValueError`` (at plan time, no job) when required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


# --------------------------------------------------------------------------- scalar columns
def with_action_weight(df: DataFrame, vocab: Mapping[str, float] = S.LOG_ACTION_WEIGHTS,
                       action: str = "action", out: str = "weight",
                       default: float = S.DEFAULT_WEIGHT) -> DataFrame:
    return df.withColumn(out, C.action_weight(action, vocab, default))


def with_action_label(df: DataFrame, vocab: Mapping[str, float] | None, action: str = "action",
                      out: str = "label") -> DataFrame:
    return df.withColumn(out, C.action_label(action, vocab))


def cast_ids(df: DataFrame, user: str = "user_id", item: str = "item_id",
             user_type: str = "string", item_type: str = "bigint") -> DataFrame:
    """Cast ids to one type (H2): ``try_cast`` so an unparsable id becomes null, not an error."""
    return (df.withColumn(user, F.col(user).try_cast(user_type))
              .withColumn(item, F.col(item).try_cast(item_type)))


def clip_category(df: DataFrame, src: str = "category_id", out: str = "category_idx",
                  lo: int = S.CATEGORY_MIN, hi: int = S.CATEGORY_MAX) -> DataFrame:
    return df.withColumn(out, C.clip(src, lo, hi).cast("int"))


def minmax(df: DataFrame, src: str = "price", out: str = "price_norm", const: float = 0.5) -> DataFrame:
    """(x - min) / (max - min) over the whole frame; a constant column maps to ``const``.

    The range is a one-row aggregate planned as a scalar subquery (computed
    once, shipped to every task as a literal) instead of a join.
    """
    rng = df.select(F.struct(F.min(src).alias("lo"), F.max(src).alias("hi"))).scalar()  # one pass
    lo, hi = rng.getField("lo"), rng.getField("hi")
    x = F.col(src).cast("double")
    return df.withColumn(out, F.when(hi == lo, F.lit(const)).otherwise((x - lo) / (hi - lo)))


def fit_zscore(dim: DataFrame, src: str = "price") -> DataFrame:
    """Mean and *population* standard deviation (one row) of ``src`` over a dimension table."""
    return dim.agg(F.avg(F.col(src).cast("double")).alias("mean"),
                   F.stddev_pop(F.col(src).cast("double")).alias("std"),
                   F.var_pop(F.col(src).cast("double")).alias("var"))


def zscore(df: DataFrame, stats, src: str = "price", out: str = "price_norm") -> DataFrame:
    """Standardise with stored statistics; a zero deviation divides by 1.

    ``stats`` is the one-row (mean, std) table (used as a scalar subquery) or,
    when the numbers are already known, a ``(mean, std)`` pair of literals."""
    if isinstance(stats, DataFrame):
        st = stats.select(F.struct(F.col("mean").alias("m"),
                                   F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("s"))).scalar()
        mean, std = st.getField("m"), st.getField("s")
    else:
        mean, std = F.lit(float(stats[0])), F.lit(float(stats[1]) if stats[1] else 1.0)
    return df.withColumn(out, (F.col(src).cast("double") - mean) / std)


# --------------------------------------------------------------------------- encoders / dims
def fit_dim(df: DataFrame, src: str, order: str = "lexicographic", out_key: str = "id",
            out_idx: str = "idx") -> DataFrame:
    """Dimension table id -> dense 0-based code.

    ``lexicographic`` orders by the id's string form (label-encoder order:
    user_1, user_10, user_100, user_2); ``natural`` orders by the id's own
    type.  Codes come from a distributed global index, never one task.
    """
    ids = df.select(F.col(src).alias(out_key)).where(F.col(out_key).isNotNull()).distinct()
    key = F.col(out_key).cast("string") if order == "lexicographic" else F.col(out_key)
    ids = ids.withColumn("_k", key)
    return global_index(ids, ["_k"], out_idx).drop("_k")


def encode(df: DataFrame, dim: DataFrame, src: str, out: str, key: str = "id", idx: str = "idx",
           how: str = "inner") -> DataFrame:
    """Replace raw ids by codes through a dimension join (unknown ids dropped unless ``how='left'``)."""
    d = dim.select(F.col(key).alias("_dim_key"), F.col(idx).alias(out))
    return df.join(d, df[src] == d["_dim_key"], how).drop("_dim_key")


def category_dim(spark) -> DataFrame:
    """The fixed six-row category dimension (code, name)."""
    rows = sorted(S.CATEGORY_NAMES.items())
    return spark.createDataFrame(rows, "category_idx INT, category_name STRING")


def decode_category(df: DataFrame, src: str = "category_idx", out: str = "category_name") -> DataFrame:
    """Attach the category name; the six-row dimension is a bounded broadcast."""
    dim = category_dim(df.sparkSession).withColumnRenamed("category_name", out)
    return df.join(F.broadcast(dim), df[src] == dim["category_idx"], "left").drop(dim["category_idx"])


# --------------------------------------------------------------------------- joins
def enrich(events: DataFrame, items: DataFrame, on: str = "item_id", how: str = "left") -> DataFrame:
    """events LEFT JOIN item dimension; the planner broadcasts the dimension only
    while its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
    (AQE re-checks at run time), otherwise it shuffles both sides."""
    return events.join(items, on, how)


# --------------------------------------------------------------------------- dedup / merge
def dedup_max_weight(df: DataFrame, keys: tuple[str, str] = ("user_idx", "item_idx"),
                     weight: str = "weight",
                     tie_break: tuple[tuple[str, bool], ...] = (("category_idx", True), ("price_norm", True),
                                                                ("label", False))) -> DataFrame:
    """One row per key pair: the highest weight, ties broken by ``tie_break`` (col, ascending).

    ``max_by`` is a declarative aggregate, so Spark combines map-side before
    the shuffle: a hot pair collapses to one row per input partition.
    """
    order = [F.col(weight)]
    for c, asc in tie_break:
        if c in df.columns:
            order.append(-F.col(c) if asc else F.col(c))
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]) \
             .select(*df.columns)


def merge(existing: DataFrame, new: DataFrame, deduplicate: bool = True,
          required: Iterable[str] = S.TRAINING_COLUMNS) -> DataFrame:
    """existing UNION ALL new (by name, after casting new to existing's types), then optional dedup.
    User ids of different types meet as strings, so no id is lost to a numeric cast."""
    validate_columns(new, required)
    if "user_idx" in existing.columns and existing.schema["user_idx"].dataType != new.schema["user_idx"].dataType:
        existing = existing.withColumn("user_idx", F.col("user_idx").cast("string"))  # ids of both sides as text (H2)
    aligned = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema.fields
                           if f.name in new.columns])
    merged = existing.unionByName(aligned, allowMissingColumns=True)
    return dedup_max_weight(merged) if deduplicate else merged


# --------------------------------------------------------------------------- item attributes
def item_meta(df: DataFrame, item: str = "item_idx", attrs: tuple[str, ...] = ("category_idx", "price_norm")) -> DataFrame:
    """One row per item (H9): the smallest (category, price_norm) pair seen for it."""
    present = [a for a in attrs if a in df.columns]
    m = df.groupBy(item).agg(F.min(F.struct(*present)).alias("_m"))
    return m.select(item, *[F.col(f"_m.{a}").alias(a) for a in present])


def distinct_item_meta(df: DataFrame, item: str = "item_idx",
                       attrs: tuple[str, ...] = ("category_idx", "price_norm")) -> DataFrame:
    return df.select(item, *[a for a in attrs if a in df.columns]).dropDuplicates()


def item_attributes(df: DataFrame, item: str = "item_idx") -> DataFrame:
    """Per item: mean price_norm and most frequent category (smallest on a tie)."""
    return df.groupBy(item).agg(
        F.avg("price_norm").alias("price_norm"),
        F.mode("category_idx", deterministic=True).cast("int").alias("category_idx"))


# --------------------------------------------------------------------------- composed: logs -> training rows
def rows_without_ids(logs: DataFrame) -> DataFrame:
    """Log rows whose user id is missing, or whose item id is missing or no number (H3)."""
    return logs.where(F.col("user_id").isNull() | F.col("item_id").try_cast("bigint").isNull())


def logs_to_training(logs: DataFrame, vocab: Mapping[str, float] = S.LOG_ACTION_WEIGHTS,
                     price_mode: str = "minmax", price_stats=None,
                     user_type: str = "string") -> DataFrame:
    """D1 log rows -> D4 training rows; user ids are strings.  Rows without a user or item id are
    left out (``rows_without_ids`` gives them, for a quarantine).

    validate -> cast ids -> label 1 -> weight by vocabulary -> price scaling
    (min-max over the batch, computed before dedup; or z-score with stored
    statistics) -> category clipped to 1..6 -> keep the highest weight per
    (user, item).
    """
    validate_columns(logs, S.LOG_COLUMNS)
    df = cast_ids(logs, user_type=user_type).where("user_id is not null and item_id is not null")
    df = df.select(F.col("user_id").alias("user_idx"), F.col("item_id").alias("item_idx"),
                   "action", "category_id", "price")
    df = with_action_label(df, None)
    df = with_action_weight(df, vocab)
    if price_mode == "zscore" and price_stats is not None:
        df = zscore(df, price_stats)
    else:
        df = minmax(df)
    df = clip_category(df)
    df = df.select(*S.TRAINING_COLUMNS)
    return dedup_max_weight(df)


def filter_category(df: DataFrame, category: int | Column | None, col: str = "category_idx") -> DataFrame:
    return df if category is None else df.where(F.col(col) == category)


def filter_available(df: DataFrame, available, item: str = "item_idx") -> DataFrame:
    """Keep rows whose item is available: a Python list becomes an IN-list, a
    DataFrame of item ids a semi-join."""
    if available is None:
        return df
    if isinstance(available, DataFrame):
        a = available.select(F.col(available.columns[0]).alias("_avail")).distinct()
        return df.join(a.hint("merge"), df[item] == a["_avail"], "left_semi")  # its size is not known before it is built
    return df.where(F.col(item).isin(list(available)))
