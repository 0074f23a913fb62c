"""Popularity and statistics of the bucketed table, kept current by signed deltas.

The state has one row per (item, category) and one per user, with counts and weight sums of the
table's rows.  All of them are sums, so a change of the table is a change of the state: rows of
the newer version count +1, rows of the older one -1, and a pair whose old row was replaced by a
heavier action takes its old weight, label and category back.  Only buckets that differ
between the two versions are read; the rest never moves.

Layout under ``root``/live:
  to=<version>,from=<version>   the delta between two versions of the table
  to=<version>,from=base        the whole state of a version

A state is its base and the deltas after it, summed by key.  Every folder follows from published
versions alone, so a run that stopped is repeated or made up for by the next one, and versions
that nobody asked for are skipped over.  Once the deltas hold as many rows as their base, they
are folded into a new one: a row is rewritten a bounded number of times however many batches come.

Weights are summed as decimals with six places, so that what is taken back leaves no residue.
Rows without a user are counted, but not as a user; rows without an item have no popularity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.streaming import bucketed as BK

KEYS = ("of_user", "user_idx", "item_idx", "category_idx")
SUMS = ("n_rows", "n_users", "n_weights", "weight", "n_positive", "n_negative")
STATE = ("of_user boolean, user_idx string, item_idx bigint, category_idx int, n_rows bigint, n_users bigint, "
         "n_weights bigint, weight decimal(28,6), n_positive bigint, n_negative bigint")


# --------------------------------------------------------------------------- deltas
def changes(spark: SparkSession, root: str, before: int | None, after: int) -> DataFrame:
    """Rows of buckets that differ between two versions, with their sign; all rows of ``after`` if ``before`` is None."""
    new = BK._pointer(spark, root, after)
    if before is None:
        return BK._rows(spark, root, new).withColumn("sign", F.lit(1))
    old = BK._pointer(spark, root, before)
    # every version that touches a bucket adds a part of it
    newest = lambda pointer: pointer.groupBy("bucket").agg(F.max("version").alias("version"))
    held = newest(old).withColumnRenamed("version", "_old")
    moved = [r["bucket"] for r in newest(new).join(held, "bucket").where(F.col("version") != F.col("_old")).select("bucket").collect()]  # at most one per bucket
    side = lambda pointer, sign: BK._rows(spark, root, pointer.where(F.col("bucket").isin(moved))).withColumn("sign", F.lit(sign))
    return side(new, 1).unionByName(side(old, -1))


def signed_sums(rows: DataFrame) -> DataFrame:
    """State rows of signed training rows: one aggregation with two grouping sets."""
    weight = F.col("weight").cast("decimal(18,6)")
    counted = lambda condition: F.sum(F.when(condition, F.col("sign")).otherwise(0)).alias
    sums = (rows.groupingSets([["item_idx", "category_idx"], ["user_idx"]], "user_idx", "item_idx", "category_idx")
            .agg(F.grouping("item_idx").cast("boolean").alias("of_user"),
                 F.sum("sign").alias("n_rows"),
                 # inside the user's own set the grouping column is the key; the copy is the row's value
                 counted(F.col("_user").isNotNull())("n_users"),
                 counted(F.col("weight").isNotNull())("n_weights"),
                 F.coalesce(F.sum(F.col("sign") * weight), F.lit(0)).cast("decimal(28,6)").alias("weight"),
                 counted(F.col("label") == 1)("n_positive"),
                 counted(F.col("label") == 0)("n_negative")))
    return sums.select(*KEYS, *SUMS)


def delta(spark: SparkSession, root: str, before: int | None, after: int) -> DataFrame:
    """The state's change between two versions; keys that do not change have no row."""
    rows = changes(spark, root, before, after).withColumn("_user", F.col("user_idx"))
    moved = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in SUMS])
    return signed_sums(rows).where(moved)


def added(states: list[DataFrame]) -> DataFrame:
    """Deltas on top of their base, by key; keys without rows are gone."""
    every = reduce(DataFrame.unionByName, states)
    out = every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return out.withColumn("weight", F.col("weight").cast("decimal(28,6)")).where("n_rows <> 0").select(*KEYS, *SUMS)


# --------------------------------------------------------------------------- stored states
def _folders(spark: SparkSession, root: str) -> dict[int, dict[int | None, str]]:
    """Written folders by the version they lead to, then by the version they start from (None: a base)."""
    out: dict[int, dict[int | None, str]] = {}
    for name in BK._children(spark, f"{root}/live"):
        if BK.exists(spark, f"{root}/live/{name}/_SUCCESS"):
            to, start = (part.split("=")[1] for part in name.split(","))
            out.setdefault(int(to), {})[None if start == "base" else int(start)] = f"{root}/live/{name}"
    return out


def _chain(folders: dict[int, dict[int | None, str]], version: int) -> list[str] | None:
    """The base and the deltas that make up a version's state, base first; None if a link is missing."""
    paths: list[str] = []
    at: int | None = version
    while at is not None:
        starts = folders.get(at)
        if not starts:
            return None
        at = None if None in starts else max(starts)
        paths.append(starts[at])
    return paths[::-1]


def _path(root: str, before: int | None, after: int) -> str:
    return f"{root}/live/to={after:012d},from={'base' if before is None else f'{before:012d}'}"


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def refreshed(spark: SparkSession, root: str) -> int | None:
    """The newest version whose state is complete."""
    folders = _folders(spark, root)
    return max((v for v in folders if _chain(folders, v) is not None), default=None)


def refresh(spark: SparkSession, root: str) -> int:
    """Bring the state to the table's current version; returns that version.

    From the newest state a delta is written; with none, or if that version's pointer was vacuumed, the
    whole table is counted.  Nothing is written if the state is current.
    """
    after = BK.current(spark, root)
    if after is None:
        raise FileNotFoundError(f"no published version under {root}")
    before = refreshed(spark, root)
    if before == after:
        return after
    if before is not None and before not in BK.versions(spark, root):
        before = None
    delta(spark, root, before, after).write.mode("overwrite").parquet(_path(root, before, after))
    if before is not None:
        _fold(spark, root, after)
    return after


def _fold(spark: SparkSession, root: str, version: int) -> None:
    base, *deltas = [_load(spark, p) for p in _chain(_folders(spark, root), version)]
    if sum(d.count() for d in deltas) >= base.count():  # row counts stand in the Parquet footers
        added([base, *deltas]).write.mode("overwrite").parquet(_path(root, None, version))


def state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The state of a refreshed version, the newest one by default: base and deltas summed by key."""
    version = refreshed(spark, root) if version is None else version
    chain = None if version is None else _chain(_folders(spark, root), version)
    if chain is None:
        raise FileNotFoundError(f"no state of version {version} under {root}")
    return added([_load(spark, p) for p in chain])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that the newest state does not need; returns their names."""
    folders = _folders(spark, root)
    newest = refreshed(spark, root)
    needed = set() if newest is None else set(_chain(folders, newest))
    gone = sorted(p for starts in folders.values() for p in starts.values() if p not in needed)
    for path in gone:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return [p.rsplit("/", 1)[1] for p in gone]


# --------------------------------------------------------------------------- what the state answers
def item_popularity(st: DataFrame) -> DataFrame:
    """Per item: smallest category, weight sum, distinct users, rows, and the composite score over all items."""
    w_share, u_share = S.POPULARITY_WEIGHTS
    per_item = (st.where(~F.col("of_user") & F.col("item_idx").isNotNull()).groupBy("item_idx")
                .agg(F.min("category_idx").alias("category_idx"), F.sum("weight").cast("double").alias("weight_sum"),
                     F.sum("n_users").alias("n_users"), F.sum("n_rows").alias("n_interactions")))
    most = per_item.select(F.struct(F.max("weight_sum").alias("w"), F.max("n_users").cast("double").alias("u"))).scalar()
    score = F.lit(w_share) * (F.col("weight_sum") / most.getField("w")) + F.lit(u_share) * (F.col("n_users") / most.getField("u"))
    return per_item.withColumn("popularity_score", score)


def popular_per_category(st: DataFrame, n: int) -> DataFrame:
    """The ``n`` most popular items of every category, ranked by the composite score, ties by item."""
    w = Window.partitionBy("category_idx").orderBy(F.col("popularity_score").desc(), F.col("item_idx"))
    return item_popularity(st).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)


def dataset_stats(st: DataFrame) -> DataFrame:
    """The one-row statistics of ``operators.stats.dataset_stats``, from the state."""
    rows = ~F.col("of_user")
    total = lambda c: F.coalesce(F.sum(F.when(rows, F.col(c))), F.lit(0)).cast("bigint").alias(c)
    weights = F.sum(F.when(rows, F.col("n_weights")))
    return st.agg(total("n_rows").alias("n_records"),
                  F.count_if(F.col("of_user") & F.col("user_idx").isNotNull()).alias("n_users"),
                  F.count_distinct(F.when(rows, F.col("item_idx"))).alias("n_items"),
                  total("n_positive"), total("n_negative"),
                  F.try_divide(F.sum(F.when(rows, F.col("weight"))).cast("double"), weights.cast("double")).alias("avg_weight"))


def category_distribution(st: DataFrame) -> DataFrame:
    """Rows, share of all rows and distinct items of every category; rows without a category are one of them."""
    per = (st.where(~F.col("of_user")).groupBy("category_idx")
           .agg(F.sum("n_rows").alias("n_rows"), F.count("item_idx").alias("n_items")))
    return per.withColumn("share", F.col("n_rows") / st.where(~F.col("of_user")).select(F.sum("n_rows").cast("double")).scalar())
