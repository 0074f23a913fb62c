"""Listing and reading many small files as Spark jobs: file names stay in a table.

Directories are listed level by level, each level by tasks over the directories found so far;
a directory whose key cannot start with the prefix, or whose date lies outside the asked
days, is never opened.  Files are read by the tasks that hold their names.  Files are
opened through ``pyarrow.fs`` (local, HDFS, object stores).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot.session import scratch_path

LISTED = "file_path string, is_dir boolean, length bigint, modified timestamp"
#: a date in a key, as day=2024-01-05 or 2024/01/05
_DATE = r"(\d{4})[-/](\d{2})[-/](\d{2})"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; local paths as file:///..."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()
    return (full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


def _lister():
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                found = [i for i in store.get_file_info(fs.FileSelector(path, recursive=False)) if i.base_name[0] not in "._"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{uri}/{i.base_name}" for i in found], pa.string()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
                     pa.array([i.size for i in found], pa.int64()), pa.array([i.mtime for i in found], pa.timestamp("us", tz="UTC"))],
                    names=["file_path", "is_dir", "length", "modified"])
    return run


def _may_hold(key, prefix: str, days: tuple[_dt.date | None, _dt.date | None] | None):
    """Whether a directory of this key (ending in /) can hold files that are asked for."""
    cond = F.lit(True)
    if prefix:
        n = F.least(F.length(key), F.lit(len(prefix)))
        cond = cond & (F.left(key, n) == F.left(F.lit(prefix), n))
    if days and (days[0] or days[1]):
        day = F.try_to_date(F.regexp_replace(F.nullif(F.regexp_extract(key, _DATE, 0), F.lit("")), "/", "-"))
        low, high = (d or default for d, default in zip(days, (_dt.date(1, 1, 1), _dt.date(9999, 12, 31))))
        cond = cond & F.coalesce(day.between(F.lit(low), F.lit(high)), F.lit(True))
    return cond


def list_files(spark: SparkSession, path: str, prefix: str = "", ext: str = "", recursive: bool = True,
               days: tuple[_dt.date | None, _dt.date | None] | None = None, max_files: int | None = None) -> DataFrame:
    """(file_path, length, modified) of the files under ``path`` whose key starts with ``prefix`` (a string
    prefix, so "2025/1" matches 10, 11, 12) and ends with ``ext``; written once, so it can be read again.

    ``days`` (first, last; either may be None) skips directories whose key holds a date outside them;
    directories without a date are listed.  ``max_files`` keeps the greatest keys.
    """
    root = qualified(spark, path)
    key = F.substring(F.col("file_path"), F.lit(len(root) + 2), F.length("file_path"))
    folders = spark.createDataFrame([(root,)], "file_path string")
    out = None
    while True:
        at = scratch_path(spark, "listing")
        folders.repartition("file_path").mapInArrow(_lister(), LISTED).write.parquet(at)
        level = spark.read.schema(LISTED).parquet(at)
        files = level.where(~F.col("is_dir") & key.startswith(prefix) & F.col("file_path").endswith(ext)).drop("is_dir")
        out = files if out is None else out.unionByName(files)
        folders = level.where(F.col("is_dir") & _may_hold(F.concat(key, F.lit("/")), prefix, days)).select("file_path")
        if not recursive or folders.isEmpty():
            break
    return out.orderBy(F.col("file_path").desc()).limit(max_files) if max_files is not None else out


def _reader():
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    store, path = fs.FileSystem.from_uri(uri)
                    with store.open_input_stream(path) as f:
                        content, error = f.read().decode("utf-8"), None
                except (OSError, UnicodeDecodeError) as e:
                    content, error = None, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([content], pa.string()), pa.array([error], pa.string())],
                                                 names=["file_path", "content", "error"])
    return run


def read_contents(files: DataFrame) -> DataFrame:
    """(file_path, content, error) of every file of a table of names; a file that cannot be opened has an error.

    The number of tasks is given: names are short, so adaptive execution would join them all into one task that reads every file."""
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("file_path").repartition(tasks).mapInArrow(_reader(), "file_path string, content string, error string")
