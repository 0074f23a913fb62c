"""File sources and sinks: interactions, JSON action logs, ledger, snapshots, encoders, vectors.

Log files are listed and read by tasks (see ``listing``): their names stay in tables and
never come to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marmot import schemas as S
from marmot.session import exists
from marmot.sources.listing import list_files, read_contents

CORRUPT = "_corrupt_record"


# --------------------------------------------------------------------------- interactions (train / val / test)
def read_interactions(spark: SparkSession, path: str, missing: str = "error", fmt: str = "csv",
                      schema: T.StructType = S.INTERACTION_SCHEMA) -> DataFrame:
    """Read an interaction table (header CSV or parquet) with the D4 schema (no inference).

    ``missing='empty'`` returns an empty frame for an absent path (merge
    path), ``'error'`` raises (recommender path).  A ``split=`` directory
    layout adds the ``split`` column by partition discovery.
    """
    if not exists(spark, path):
        if missing == "empty":
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write the split table partitioned by ``split`` (header CSV or parquet, no index column)."""
    w = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


# --------------------------------------------------------------------------- JSON action logs
def write_logs_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                    layout: str = "lines", rows_per_file: int = 100_000) -> str:
    """Write log rows as JSON: ``lines`` one object per line, ``array`` one JSON array per file (at most
    about ``rows_per_file`` rows of one directory each, so a large day is several files)."""
    keys = list(partition_by or [])
    if layout == "lines":
        w = df.write.mode(mode)
        (w.partitionBy(*keys) if keys else w).json(path)
        return path
    n_files = F.ceil(F.count(F.lit(1)) / rows_per_file)
    plain = [c for c in df.columns if c not in keys]
    row = F.struct(*plain)
    sized = df.join(df.groupBy(*keys).agg(n_files.alias("_files")), keys) if keys else df.withColumn("_files", df.select(n_files).scalar())
    chunked = sized.withColumn("_file", F.pmod(F.xxhash64(row), F.col("_files")))
    arrays = chunked.groupBy(*keys, "_file").agg(F.to_json(F.collect_list(row)).alias("value")).drop("_file")
    w = arrays.write.mode(mode).option("maxRecordsPerFile", 1)
    (w.partitionBy(*keys) if keys else w).text(path)
    return path


def list_log_files(spark: SparkSession, path: str, prefix: str = "", ext: str = ".json", recursive: bool = True,
                   days=None, max_files: int | None = None) -> DataFrame:
    """(file_path, length, modified) of the log files under ``path``; see ``listing.list_files``."""
    return list_files(spark, path, prefix, ext, recursive, days, max_files)


def read_log_files(files: DataFrame, multiline: bool = True, schema: T.StructType = S.LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """The files of a table of names -> (good rows with ``file_path``, bad records with ``file_path``).

    multiline=True: each file is one JSON document (an array of log objects, or one object); False: one
    object per line.  A document or line that cannot be parsed, and a file that cannot be
    opened, is a bad record; empty arrays and blank files have no rows.
    """
    records = log_records(files, multiline, schema)
    return good_records(records), bad_records(records)


def good_records(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNotNull()).select("file_path", CORRUPT)


def log_records(files: DataFrame, multiline: bool = True, schema: T.StructType = S.LOG_SCHEMA) -> DataFrame:
    """Good rows and bad records of the files in one pass: the log columns, ``file_path`` and the unparsed text, null in good rows."""
    contents = read_contents(files)
    if multiline:
        docs = contents.withColumn("_d", F.trim("content"))
        rows = F.from_json("_d", T.ArrayType(schema))
        opened = rows.isNotNull() & F.col("_d").rlike(r"(?s)^[\[{].*[\]}]\s*$")
        parsed = docs.withColumn("_rows", F.when(opened, rows))
        bad = F.col("_rows").isNull() & (F.col("content").isNull() | (F.trim(F.regexp_replace("content", r"\s+", " ")) != ""))
        # a bad document is one record without a row
        marked = parsed.select("file_path", F.when(bad, F.coalesce("content", "error")).alias(CORRUPT),
                               F.when(bad, F.array(F.lit(None).cast(schema))).otherwise(F.col("_rows")).alias("_rows"))
        return (marked.select("file_path", CORRUPT, F.explode("_rows").alias("_r")).where(F.col("_r").isNotNull() | F.col(CORRUPT).isNotNull())
                .select("_r.*", "file_path", CORRUPT))
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = contents.select("file_path", "error", F.explode_outer(F.split("content", r"\r?\n")).alias("_line")).where("_line is null or trim(_line) <> ''")
    parsed = lines.withColumn("_r", F.from_json("_line", full, {"columnNameOfCorruptRecord": CORRUPT}))
    lost = F.col("_line").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    return parsed.select(*[F.col(f"_r.{f.name}") for f in schema.fields], "file_path", F.when(lost, F.coalesce("_line", "error")).alias(CORRUPT))


def read_logs(spark: SparkSession, path: str, multiline: bool = True, ext: str = ".json", recursive: bool = True,
              schema: T.StructType = S.LOG_SCHEMA, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Read the log files under ``path`` whose key starts with ``prefix`` -> (good rows, bad records), both with
    ``file_path``; see ``read_log_files``."""
    return read_log_files(list_log_files(spark, path, prefix, ext, recursive), multiline, schema)


def filter_by_timestamp(logs: DataFrame, start: _dt.datetime | int | None = None,
                        end: _dt.datetime | int | None = None, ts: str = "timestamp") -> DataFrame:
    """Inclusive [start, end] on an epoch-ms column; either bound optional.  Rows
    without a timestamp are dropped unless both bounds are absent.  Bounds become
    epoch-ms literals compared with the raw column, so the predicate reaches the scan."""
    if start is None and end is None:
        return logs
    cond = F.col(ts).isNotNull()
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(_as_ms(start)))
    if end is not None:
        cond = cond & (F.col(ts) <= F.lit(_as_ms(end)))
    return logs.where(cond)


def _as_ms(v) -> int:
    """int -> itself (epoch ms); naive datetimes are UTC wall clock (H18)."""
    if isinstance(v, int):
        return v
    if v.tzinfo is None:
        v = v.replace(tzinfo=_dt.timezone.utc)
    return int(v.timestamp() * 1000)


# --------------------------------------------------------------------------- file-state ledger
#: states of a file: its rows are in the table; it had no rows; it could not be read
DONE, EMPTY, FAILED = "done", "empty", "failed"


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's entries (file_path, state, processed_at), one per file and attempt; absent -> empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], S.LEDGER_SCHEMA)
    return spark.read.schema(S.LEDGER_SCHEMA).parquet(path)


def file_states(ledger: DataFrame) -> DataFrame:
    """(file_path, state, attempts): a file that was ever done is done, else its last state; attempts counts its entries."""
    return ledger.groupBy("file_path").agg(
        F.when(F.max(F.col("state") == DONE), DONE).otherwise(F.max_by("state", "processed_at")).alias("state"),
        F.count(F.lit(1)).alias("attempts"))


def mark_processed(files: DataFrame, path: str, state: str = DONE) -> None:
    """Append an attempt of each file to the ledger; called only after the data it fed is committed (H5)."""
    (files.select("file_path").distinct().withColumn("state", F.lit(state)).withColumn("processed_at", F.current_timestamp())
          .write.mode("append").parquet(path))


def outcome(files: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """(file_path, state) of files that were read: rows make it done, even beside bad lines; else bad
    records make it failed; else it was empty."""
    seen = good.select("file_path").distinct().withColumn("_good", F.lit(True))
    torn = bad.select("file_path").distinct().withColumn("_bad", F.lit(True))
    return (files.select("file_path").join(seen, "file_path", "left").join(torn, "file_path", "left")
            .select("file_path", F.when(F.col("_good"), DONE).when(F.col("_bad"), FAILED).otherwise(EMPTY).alias("state")))


def record(outcomes: DataFrame, path: str) -> None:
    """Append one attempt of every file with its state."""
    outcomes.select("file_path", "state").withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(path)


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are not done: new ones, and empty and failed ones, which are tried again."""
    done = ledger.where(F.col("state") == DONE).select("file_path").distinct()
    return files.join(done, "file_path", "left_anti")


def latest_unprocessed(good_rows: DataFrame, ledger: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows of the ``n`` greatest file keys among unprocessed files that yielded at least
    one good row (empty / unreadable files do not count).  Returns (rows, chosen files)."""
    files = unprocessed(good_rows.select("file_path").distinct(), ledger)
    chosen = files.orderBy(F.col("file_path").desc()).limit(n)  # n file names: bounded
    return good_rows.join(chosen, "file_path", "left_semi"), chosen


def fetch_latest_logs(spark: SparkSession, path: str, ledger: DataFrame, n: int = 10, prefix: str = "",
                      ext: str = ".json", multiline: bool = True, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the ``n`` greatest unprocessed file keys that hold at least one good row,
    reading only candidate files, never the processed history.

    The names are listed by tasks and stay in a table; of ``max_files`` the greatest keys are looked at.
    The newest ``2 n`` unprocessed files are read first; while fewer than ``n`` of them
    hold rows, the window grows fourfold (empty and unreadable files do not count, and are not marked
    done, so later runs try them again).  The names of files with rows are kept, so a window is read
    once and the chosen files once more for their rows.  Returns (rows, chosen files).
    """
    files = unprocessed(list_log_files(spark, path, prefix, ext, max_files=max_files), ledger).select("file_path")
    total, window = files.count(), 2 * n
    while True:
        good, _ = read_log_files(files.orderBy(F.col("file_path").desc()).limit(window), multiline)
        have = good.select("file_path").distinct().checkpoint(eager=True)
        if window >= total or have.count() >= n:
            chosen = have.orderBy(F.col("file_path").desc()).limit(n)
            return read_log_files(chosen, multiline)[0], chosen
        window *= 4


def fetch_logs_by_date(spark: SparkSession, path: str, ledger: DataFrame, start=None, end=None, prefix: str = "",
                       ext: str = ".json", multiline: bool = True, day_folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of unprocessed files inside [start, end]; returns (rows, files with at least one surviving row =
    the files to mark).  ``day_folders``: a folder with a date in its key holds rows of that day
    (UTC) only, so folders of other days are not even listed."""
    days = None
    if day_folders:
        days = tuple(None if v is None else _dt.datetime.fromtimestamp(_as_ms(v) / 1000, _dt.timezone.utc).date() for v in (start, end))
    good, _ = read_log_files(unprocessed(list_log_files(spark, path, prefix, ext, days=days), ledger), multiline)
    rows = filter_by_timestamp(good, start, end)
    return rows, rows.select("file_path").distinct()


# --------------------------------------------------------------------------- versioned snapshots
def write_snapshot(df: DataFrame, base: str, version: str | None = None, fmt: str = "parquet") -> str:
    """Write ``df`` as a new version under ``base/version=<v>`` and record it in
    ``base/_versions``; older versions stay as backups (nothing is renamed or
    overwritten in place, so a table can be rewritten from its own previous version)."""
    spark = df.sparkSession
    v = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    df.write.mode("overwrite").format(fmt).save(f"{base}/version={v}")
    spark.createDataFrame([(v, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))],
                          "version STRING, written_at TIMESTAMP") \
         .write.mode("append").parquet(f"{base}/_versions")
    return v


def current_version(spark: SparkSession, base: str) -> str | None:
    if not exists(spark, f"{base}/_versions"):
        return None
    # the version written last, whatever its name (v10 after v2)
    return spark.read.parquet(f"{base}/_versions").select(F.max_by("version", F.struct("written_at", "version"))).first()[0]


def read_snapshot(spark: SparkSession, base: str, version: str | None = None, fmt: str = "parquet") -> DataFrame:
    v = version or current_version(spark, base)
    if v is None:
        raise FileNotFoundError(f"no version under {base}")
    return spark.read.format(fmt).load(f"{base}/version={v}")


# --------------------------------------------------------------------------- encoders, vectors
def write_encoders(path: str, user_dim: DataFrame, item_dim: DataFrame, category_dim: DataFrame,
                   price_stats: DataFrame) -> str:
    """Persist the encoder tables (dims + one-row price statistics) as parquet."""
    for name, df in (("user_dim", user_dim), ("item_dim", item_dim), ("category_dim", category_dim),
                     ("price_stats", price_stats)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def read_encoders(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("user_dim", "item_dim", "category_dim", "price_stats")}


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors table -> (item_idx, embedding ARRAY<FLOAT>)."""
    return spark.read.parquet(path).select(F.col(id_col).alias("item_idx"), F.col(vec_col).alias("embedding"))
