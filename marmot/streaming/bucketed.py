"""A training table in buckets of users, kept current by writing touched buckets only.

Layout under ``root``:
  data/v=<version>/bucket=<b>/   the part of a bucket that a version wrote
  pointers/v=<version>/          for every bucket the versions that hold its parts, with their rows; a
                                 version is published by this one small write, when its _SUCCESS appears

A batch writes one new part of each bucket of its users.  Newer parts of the bucket that hold no
more rows than the batch has gathered are merged into it, so a part is at least outgrown by the
older one before it is written again: a row is rewritten about log2(table / batch) times, however
many batches come, and a bucket has as many parts at most.  Readers take the newest published
pointer and merge parts by the highest-weight rule, which does not depend on how rows are grouped;
whatever a stopped run left without a pointer is never read and is overwritten by the next one.
Older pointers keep older versions readable: they are the backups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators import prepare as P
from marmot.operators.stats import compare_before_after
from marmot.session import exists, scratch_path
from marmot.sources import files as FS

POINTER = "bucket int, version bigint, source string, n_rows bigint"


def _tag(version: int) -> str:
    return f"v={version:012d}"


def bucket_of(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(buckets)).cast("int")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names under a folder (one per version: few)."""
    if not exists(spark, path):
        return []
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    return [int(n[2:]) for n in _children(spark, f"{root}/pointers") if n.startswith("v=") and exists(spark, f"{root}/pointers/{n}/_SUCCESS")]


def current(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def _pointer(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(POINTER).parquet(f"{root}/pointers/{_tag(version)}")


def _rows(spark: SparkSession, root: str, pointer: DataFrame) -> DataFrame:
    """The rows of a pointer's buckets: one scan of each version it names, its buckets pruned by folder.

    Buckets of several parts are merged; those of one part are read as they are."""
    return _union(spark, root, [(r["bucket"], r["version"]) for r in pointer.select("bucket", "version").collect()])  # a row per part


def _union(spark: SparkSession, root: str, held: list[tuple[int, int]]) -> DataFrame:
    """The rows of (bucket, version) parts."""
    n_parts = Counter(b for b, _ in held)
    none = spark.createDataFrame([], S.INTERACTION_SCHEMA)
    single, several = (reduce(DataFrame.unionByName, [_part(spark, root, v, [b for b, at in held if at == v and (n_parts[b] > 1) == many])
                                                      for v in sorted({v for b, v in held if (n_parts[b] > 1) == many})], none) for many in (False, True))
    return single.unionByName(P.dedup_max_weight(several)) if any(n > 1 for n in n_parts.values()) else single


def _part(spark: SparkSession, root: str, version: int, buckets: list[int]) -> DataFrame:
    path = f"{root}/data/{_tag(version)}"
    if not any(n.startswith("bucket=") for n in _children(spark, path)):  # none of an empty table
        return spark.createDataFrame([], S.INTERACTION_SCHEMA)
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets)).select(*S.TRAINING_COLUMNS)


def _typed(rows: DataFrame) -> DataFrame:
    """The training columns with the table's types; user ids are strings."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.INTERACTION_SCHEMA.fields])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version, the newest published one by default."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no published version under {root}")
    return _rows(spark, root, _pointer(spark, root, version))


def _write(rows: DataFrame, root: str, version: int, buckets: int) -> None:
    """Rows by bucket; the rebalance splits a bucket of many rows and joins small ones."""
    (rows.withColumn("bucket", bucket_of(F.col("user_idx"), buckets)).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/{_tag(version)}"))


def _written(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Rows by bucket of what a version wrote; one entry per bucket."""
    path = f"{root}/data/{_tag(version)}"
    if not any(n.startswith("bucket=") for n in _children(spark, path)):
        return {}
    return {r["bucket"]: r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()}


def _publish(pointer: DataFrame, root: str, version: int) -> None:
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointers/{_tag(version)}")


def create(spark: SparkSession, root: str, base: DataFrame, buckets: int = 64) -> int:
    """Write ``base`` (training columns; of repeated pairs the highest weight) as version 0, unless the table is there."""
    at = current(spark, root)
    if at is None:
        _write(P.dedup_max_weight(_typed(base)), root, 0, buckets)
        sizes = _written(spark, root, 0)
        _publish(spark.createDataFrame([(b, 0, "", sizes.get(b, 0)) for b in range(buckets)], POINTER), root, 0)
        at = 0
    return at


def merge_batch(spark: SparkSession, root: str, new: DataFrame, source: str) -> int:
    """Write rows as parts of their buckets, with the smaller parts there, and publish the next version; returns the current version.

    ``source`` names the batch: if the newest version has it, the batch is there already (a replay
    after a stop) and nothing is written.  A batch without rows writes nothing either.
    """
    at = current(spark, root)
    pointer = _pointer(spark, root, at)
    if pointer.where(F.col("source") == source).limit(1).count():
        return at
    parts: dict[int, list] = {}
    for r in pointer.orderBy("bucket", "version").collect():  # a row per part, a few parts per bucket
        parts.setdefault(r["bucket"], []).append(r)
    rows = _typed(new).withColumn("bucket", bucket_of(F.col("user_idx"), len(parts)))
    touched = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most one per bucket
    if not touched:
        return at
    joined: list[tuple[int, int]] = []
    for bucket, n in touched.items():
        stack = parts[bucket]
        while stack and (stack[-1]["n_rows"] is None or stack[-1]["n_rows"] <= n):  # pointers of old had no rows noted
            last = stack.pop()
            joined.append((bucket, last["version"]))
            n += last["n_rows"] or 0
    _write(P.merge(_union(spark, root, joined), rows.drop("bucket")), root, at + 1, len(parts))
    sizes = _written(spark, root, at + 1)
    kept = [(r["bucket"], r["version"], r["source"], r["n_rows"]) for stack in parts.values() for r in stack]
    _publish(spark.createDataFrame(kept + [(b, at + 1, source, sizes[b]) for b in touched], POINTER), root, at + 1)
    return at + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete what none of the newest ``keep`` versions needs; returns the data versions deleted."""
    kept = versions(spark, root)[-keep:]
    needed = {r["version"] for v in kept for r in _pointer(spark, root, v).select("version").distinct().collect()}
    gone = [int(n[2:]) for n in _children(spark, f"{root}/data") if n.startswith("v=") and int(n[2:]) not in needed and int(n[2:]) <= max(kept)]
    doomed = [f"{root}/pointers/{_tag(v)}" for v in versions(spark, root) if v not in kept] + [f"{root}/data/{_tag(v)}" for v in gone]
    for path in doomed:
        _delete(spark, path)
    return gone


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


# --------------------------------------------------------------------------- the incremental job
def ingest(spark: SparkSession, src: str, root: str, ledger: str, price_stats: DataFrame, n_files: int = 10, prefix: str = "",
           ext: str = ".json", multiline: bool = True, vocab=S.LOG_ACTION_WEIGHTS, quarantine: str | None = None) -> int:
    """Merge the ``n_files`` newest unprocessed files that hold rows, then note every file read in the ledger.

    Done files are never read again; empty and failed ones are tried again by later runs.  Bad records and
    rows without ids go to ``quarantine`` (``root``/quarantine), one folder per version.  If the run
    stops before the ledger is written, the next one merges the same files again, which changes
    nothing (the highest-weight rule is idempotent).  Returns the number of files that are now done.
    """
    waiting = FS.unprocessed(FS.list_log_files(spark, src, prefix, ext), FS.load_ledger(spark, ledger)).select("file_path")
    total, window = waiting.count(), 2 * n_files
    scratch = scratch_path(spark, "ingest")
    while True:
        tried = waiting.orderBy(F.col("file_path").desc()).limit(window).checkpoint(eager=True)
        # the files are opened and parsed once; what follows reads the written records
        FS.log_records(tried, multiline).write.mode("overwrite").parquet(f"{scratch}/records")
        records = spark.read.parquet(f"{scratch}/records")
        good, bad = FS.good_records(records), FS.bad_records(records)
        outcomes = FS.outcome(tried, good, bad).checkpoint(eager=True)
        done = outcomes.where(F.col("state") == FS.DONE).orderBy(F.col("file_path").desc()).limit(n_files).checkpoint(eager=True)
        names = done.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_path")).alias("x")).first()
        if window >= total or names["n"] >= n_files:
            break
        window *= 4
    if names["n"]:
        row = price_stats.first()  # one row
        logs, torn = good.join(done, "file_path", "left_semi").select(*good.columns), bad.join(done, "file_path", "left_semi")
        rows = P.logs_to_training(logs.drop("file_path"), vocab, price_mode="zscore", price_stats=(row["mean"], row["std"]))
        rows.write.parquet(f"{scratch}/rows")
        new = spark.read.parquet(f"{scratch}/rows")
        version = merge_batch(spark, root, new, f"{names['n']} files, {names['x']}")
        _quarantine(torn, logs, quarantine or f"{root}/quarantine", version)
    # files with rows beyond n_files wait for a later run and are not noted
    FS.record(done.unionByName(outcomes.where(F.col("state") != FS.DONE)), ledger)
    _delete(spark, scratch)
    return names["n"]


def _quarantine(bad: DataFrame, logs: DataFrame, path: str, version: int) -> None:
    lost = bad.withColumnRenamed(FS.CORRUPT, "unparsed").unionByName(P.rows_without_ids(logs), allowMissingColumns=True)
    lost.write.mode("overwrite").json(f"{path}/{_tag(version)}")


def trained_version(spark: SparkSession, root: str) -> int | None:
    """The last version that was compared and trained on."""
    done = [int(n[2:]) for n in _children(spark, f"{root}/trained") if n.startswith("v=") and exists(spark, f"{root}/trained/{n}/_SUCCESS")]
    return max(done, default=None)


def update_job(spark: SparkSession, src: str, base: DataFrame, root: str, ledger: str, price_stats: DataFrame,
               retrain: Callable[[DataFrame], object] | None = None, buckets: int = 64, **options) -> tuple[DataFrame | None, DataFrame]:
    """One incremental run: ingest new files, compare the table before and after, retrain.

    The version last trained on stays readable and is the backup.  Comparison and retraining are due whenever
    the published version is newer than that one, so a run that stopped between the two is made
    up for by the next, even if no file is new.  Returns (comparison, table); with nothing due the
    comparison is None.
    """
    create(spark, root, base, buckets)
    if trained_version(spark, root) is None:
        _mark_trained(spark, root, 0)
    ingest(spark, src, root, ledger, price_stats, **options)
    before, after = trained_version(spark, root), current(spark, root)
    table = read(spark, root, after)
    if after == before:
        return None, table
    at = f"{root}/comparisons/{_tag(after)}"
    compare_before_after(read(spark, root, before), table).write.mode("overwrite").parquet(at)
    if retrain is not None:
        retrain(table)
    _mark_trained(spark, root, after)
    return spark.read.parquet(at), table


def _mark_trained(spark: SparkSession, root: str, version: int) -> None:
    spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{root}/trained/{_tag(version)}")
