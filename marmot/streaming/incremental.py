"""Incremental ingest as a Structured Streaming job.

new log files -> logs_to_training -> delta of the training table.

Layout under ``out``:
  deltas/batch=b<batch_id>/   rows of one micro-batch (already one row per pair)
  base/version=c<batch_id>/   compacted table including every delta up to that batch
  base/_versions              version log (see sources.files.write_snapshot)

A micro-batch writes only its own delta, so its cost is proportional to the
batch, not to the table; a replayed batch overwrites its own delta with the
same rows (idempotent).  The stream checkpoint is the processed-file ledger: a
file is committed only after its batch's delta is written (H5).  Readers take
the newest base plus the deltas after it and apply the highest-weight-per-pair
rule, which is associative, so any grouping of batches gives the same table as
one merge of everything.  ``compact`` folds the live deltas into a new base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marmot import schemas as S
from marmot.operators import prepare as P
from marmot.operators.stats import compare_before_after
from marmot.session import exists
from marmot.sources import files as FS


def _batch_tag(batch_id: int) -> str:
    return f"b{batch_id:012d}"


def _base_info(spark: SparkSession, out: str) -> tuple[str | None, str]:
    """(newest base version or None, tag of the last batch folded into it)."""
    v = FS.current_version(spark, f"{out}/base")
    return v, ("b" + v[1:] if v else "")


def read_merged(spark: SparkSession, out: str, base_train: DataFrame) -> DataFrame:
    """The current training table: newest base (or the original table) + later deltas, deduplicated."""
    version, through = _base_info(spark, out)
    base = FS.read_snapshot(spark, f"{out}/base", version) if version else base_train.select(*S.TRAINING_COLUMNS)
    if not exists(spark, f"{out}/deltas"):
        return base
    deltas = (spark.read.option("basePath", f"{out}/deltas").parquet(f"{out}/deltas")
                   .where(F.col("batch") > F.lit(through)).select(*S.TRAINING_COLUMNS))
    return P.merge(base, deltas, deduplicate=True)


def compact(spark: SparkSession, out: str, base_train: DataFrame) -> str | None:
    """Write base + live deltas as a new base version tagged with the last folded batch."""
    if not exists(spark, f"{out}/deltas"):
        return None
    last = (spark.read.option("basePath", f"{out}/deltas").parquet(f"{out}/deltas")
                 .select(F.max("batch")).first()[0])
    _, through = _base_info(spark, out)
    if last is None or last <= through:
        return None
    version = "c" + last[1:]
    FS.write_snapshot(read_merged(spark, out, base_train), f"{out}/base", version)
    return version


def live_deltas(spark: SparkSession, out: str) -> int:
    if not exists(spark, f"{out}/deltas"):
        return 0
    _, through = _base_info(spark, out)
    return (spark.read.option("basePath", f"{out}/deltas").parquet(f"{out}/deltas")
                 .where(F.col("batch") > F.lit(through)).select("batch").distinct().count())


def run_incremental(spark: SparkSession, src: str, base_train: DataFrame, out: str, checkpoint: str,
                    n_files: int = 10, price_stats: DataFrame | None = None, multiline: bool = True,
                    vocab=S.LOG_ACTION_WEIGHTS, quarantine: str | None = None,
                    compact_every: int = 8, latest_first: bool = False) -> DataFrame:
    """Drain every new file under ``src`` (``n_files`` per micro-batch), then return the
    merged training table; compacts when ``compact_every`` deltas are live.

    A file is one JSON array of log objects (``multiline=False``: one object per line).
    Unparsable records and rows without ids go to ``quarantine`` (``out``/quarantine unless
    named), one folder per batch, so a replayed batch rewrites its own.  ``price_stats``
    (mean, std) are required: a range taken from each batch would make the table depend on
    how files fall into batches.  ``latest_first`` takes the newest files (by modification
    time) first within the backlog; with ``availableNow`` all of it is drained either way."""
    if price_stats is None:
        raise ValueError("price_stats (mean, std) are required: batches share one price scale")
    quarantine = quarantine or f"{out}/quarantine"
    schema = T.StructType(S.LOG_SCHEMA.fields + [T.StructField(FS.CORRUPT, T.StringType())])
    stream = (spark.readStream.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE")
                   .option("columnNameOfCorruptRecord", FS.CORRUPT).option("maxFilesPerTrigger", n_files)
                   .option("latestFirst", str(latest_first).lower()).option("recursiveFileLookup", "true")
                   .option("pathGlobFilter", "*.json").json(src))
    row = price_stats.first()  # one row
    stats = (row["mean"], row["std"])  # literals, no per-batch subquery

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        keep = F.length(F.coalesce(F.col("action"), F.lit(""))) >= 0  # keeps a parsed column referenced
        logs = batch.where(F.col(FS.CORRUPT).isNull() & keep).drop(FS.CORRUPT)
        bad = batch.where(F.col(FS.CORRUPT).isNotNull() & keep).unionByName(P.rows_without_ids(logs), allowMissingColumns=True)
        bad.withColumnRenamed(FS.CORRUPT, "unparsed").write.mode("overwrite").json(f"{quarantine}/batch={_batch_tag(batch_id)}")
        new = P.logs_to_training(logs, vocab, price_mode="zscore", price_stats=stats)
        new.write.mode("overwrite").parquet(f"{out}/deltas/batch={_batch_tag(batch_id)}")

    q = (stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if compact_every and live_deltas(spark, out) >= compact_every:
        compact(spark, out, base_train)
    return read_merged(spark, out, base_train)


def last_batch(spark: SparkSession, out: str) -> str | None:
    """Tag of the newest delta."""
    if not exists(spark, f"{out}/deltas"):
        return None
    return (spark.read.option("basePath", f"{out}/deltas").parquet(f"{out}/deltas").select(F.max("batch")).first()[0])


def update_job(spark: SparkSession, src: str, base_train: DataFrame, out: str, checkpoint: str, price_stats: DataFrame,
               retrain: Callable[[DataFrame], object] | None = None, **options) -> tuple[DataFrame | None, DataFrame]:
    """One incremental run: backup, merge, comparison, optional retraining.

    The table before the run is kept as a version under ``out``/backups; the statistics
    before and after go to ``out``/comparisons; ``retrain`` is called with the new table.
    Returns (comparison, table); without new files nothing is compared or retrained and
    the comparison is None.
    """
    seen = last_batch(spark, out)
    before = read_merged(spark, out, base_train)
    version = FS.write_snapshot(before, f"{out}/backups")
    kept = FS.read_snapshot(spark, f"{out}/backups", version)  # a fixed table: the live one changes below
    after = run_incremental(spark, src, base_train, out, checkpoint, price_stats=price_stats, **options)
    if last_batch(spark, out) == seen:
        return None, after
    comparison = compare_before_after(kept, after)
    comparison.write.mode("overwrite").parquet(f"{out}/comparisons/version={version}")
    if retrain is not None:
        retrain(after)
    return spark.read.parquet(f"{out}/comparisons/version={version}"), after
