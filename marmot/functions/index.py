"""Exact global row numbering without funnelling rows through one task.

``row_number()`` over an un-partitioned window moves every row into a single
task.  Instead we range-partition on the ordering key, sort inside each
partition, and add each partition's offset (the count of all rows in earlier
partitions).  Only the per-partition counts (one row per partition) ever
meet in one place.  The range-partitioned, id-tagged rows are checkpointed to
the shared checkpoint folder first: range boundaries are chosen by sampling,
so re-evaluating the plan could move rows between partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marmot.session import checkpoint_dir

_PID_SHIFT = 33  # monotonically_increasing_id puts the partition id in the upper 31 bits


ROWS_PER_RANGE = 1_000_000


def global_index(df: DataFrame, order: list[str | Column], index_col: str = "idx",
                 partitions: int | None = None, start: int = 0, spread_ties: bool = False,
                 rows: int | None = None) -> DataFrame:
    return global_index_with_count(df, order, index_col, partitions, start, spread_ties, rows)[0]


def global_index_with_count(df: DataFrame, order: list[str | Column], index_col: str = "idx",
                            partitions: int | None = None, start: int = 0,
                            spread_ties: bool = False, rows: int | None = None) -> tuple[DataFrame, int]:
    """Attach a dense 0-based (or ``start``-based) position under ``order``.

    ``order`` must be a total order (add a unique tie-breaker) for the result
    to be deterministic.  ``spread_ties`` appends a per-row id to the sort key
    so that one heavily repeated value cannot land in a single range partition
    (use it when the order among equal values does not matter).

    The number of ranges grows with the input (about ``ROWS_PER_RANGE`` rows
    each, never fewer than the shuffle-partition setting); callers that already
    counted pass ``rows``, otherwise one counting pass decides it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if partitions is None:
        rows = df.count() if rows is None else rows
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    n = partitions
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if spread_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        order_cols = order_cols + [F.col("_tie")]
    tagged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    counts = (tagged.groupBy(F.shiftright("_mid", _PID_SHIFT).alias("_pid"))
                    .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    # one row per partition: an un-partitioned window here is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first", "_n",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")).checkpoint(eager=True)
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]  # one row per partition summed
    out = (tagged.join(F.broadcast(offsets), F.shiftright(tagged["_mid"], _PID_SHIFT) == offsets["_pid"])
                  .withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(start)).cast("bigint"))
                  .drop("_mid", "_pid", "_first", "_off", "_n", "_tie"))
    return out, int(total)
