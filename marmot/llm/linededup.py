"""Repeated line runs by a suffix array over line-ID sequences; DataFrame operations only.

1. A document is the sequence of its non-blank lines.  Lines that occur once cannot be in
   a repeated run; what is left are stretches of repeated lines, of which only those with
   ``min_words`` words or more matter.
2. *Prefix doubling.*  Rank 0 of a position is the place of its line among the repeated
   lines in sorted order.  Rank j+1 is the place of the pair (rank j here, rank j 2**j lines
   on) among the sorted pairs that occur twice or more: equal ranks are suffixes with a
   common prefix of 2**(j+1) lines, that is, members of one longest-common-prefix interval.
   Places come from a range-partitioned sort with partition offsets, so a very common line
   is spread by what follows it, and a suffix that has become unique leaves.
3. A run counts from ``min_words`` words on.  Its shortest counting prefix at a position,
   and shortest counting suffix up to a position, are windows of m lines; two overlapping
   ranks of depth floor(log2 m) and m identify a window, and a maximal run is the union of
   its windows, so no rank deeper than the longest window is needed.
4. Every occurrence of a window but the first (by doc_id, row, line) is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marmot.functions.index import global_index
from marmot.llm.common import saved

#: words of the shortest run that counts; a line's words are its spaces, after trimming, and one
MIN_WORDS = 20


def _lines(base: DataFrame, cap: int) -> DataFrame:
    """row, doc, idx (place among the non-blank lines), pos (place among all), two line fingerprints, words up to ``cap``."""
    each = F.expr(f"""transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(i as pos, trim(x) as t, x as x)), s -> s.t <> ''),
        s -> struct(s.pos as pos, xxhash64(s.x) as k1, xxhash64('line', s.x) as k2,
                    least({cap}, 1 + length(s.t) - length(replace(s.t, ' ', ''))) as words))""")
    return (base.where("text is not null").select("_row", F.col("doc_id").alias("doc"), F.posexplode(each).alias("idx", "s"))
            .select("_row", "doc", "idx", "s.pos", "s.k1", "s.k2", "s.words"))


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that occur twice or more, with their place in sorted order."""
    often = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return global_index(often, keys, name, partitions=n)


def _at_level(level: Column, depth: int) -> Column:
    out = F.lit(None).cast("bigint")
    for j in range(depth):
        out = F.when(level == j, F.col(f"r{j}")).otherwise(out)
    return out


def deleted_lines(base: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, pos): the lines of ``base`` (_row, doc_id, text) that belong to a later copy of a repeated run."""
    lines = saved(_lines(base, min_words), "lines")
    # a common line is counted on the map side; its rows are joined, and that join can be split
    often = _ranked(lines, ["k1", "k2"], "r0")
    by_place = Window.partitionBy("_row").orderBy("idx")
    stretch = Window.partitionBy("_row", "part")
    kept = (lines.join(often, ["k1", "k2"]).withColumn("part", F.col("idx") - F.row_number().over(by_place))
            .withColumn("total", F.sum("words").over(stretch)).where(F.col("total") >= min_words))
    in_order = stretch.orderBy("idx")
    kept = (kept.withColumn("upto", F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("from", F.col("upto") - F.col("words"))
            .withColumn("lo", F.min("idx").over(stretch)).withColumn("hi", F.max("idx").over(stretch)))
    w = min_words
    ahead = stretch.orderBy("from").rangeBetween(w, 2 * w - 1)  # words are capped, so the next counting end is this near
    behind = stretch.orderBy("upto").rangeBetween(-(2 * w - 1), -w)
    kept = (kept.withColumn("end", F.coalesce(F.min("idx").over(ahead), F.when(F.col("total") - F.col("from") >= w, F.col("hi") + 1)))
            .withColumn("begin", F.coalesce(F.max("idx").over(behind) + 1, F.when(F.col("upto") >= w, F.col("lo")))))
    active = saved(kept.select("_row", "doc", "part", "idx", "pos", "r0", "end", "begin"), "line-active")
    longest = active.agg(F.max(F.greatest(F.col("end") - F.col("idx"), F.col("idx") + 1 - F.col("begin")))).first()[0] or 0
    depth = 1
    while 2**depth <= longest:  # at most log2(min_words) rounds
        last = f"r{depth - 1}"
        ahead = F.lead(last, 2 ** (depth - 1)).over(Window.partitionBy("_row", "part").orderBy("idx"))
        paired = saved(active.withColumn("_next", ahead), "line-pairs")
        places = _ranked(paired.where(f"{last} is not null and _next is not null"), [last, "_next"], f"r{depth}")
        active = saved(paired.join(places, [last, "_next"], "left").drop("_next"), "line-ranks")
        depth += 1
    ranks = active.select("_row", "idx", *(f"r{j}" for j in range(depth)))
    windows = (active.where("end is not null").select("_row", "doc", F.col("idx").alias("s"), (F.col("end") - F.col("idx")).alias("m"))
               .unionByName(active.where("begin is not null").select("_row", "doc", F.col("begin").alias("s"), (F.col("idx") + 1 - F.col("begin")).alias("m")))
               .distinct().withColumn("level", F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int"))
               .withColumn("idx", F.col("s")))
    left = (windows.join(ranks, ["_row", "idx"]).withColumn("a", _at_level(F.col("level"), depth)).where("a is not null")
            .select("_row", "doc", "s", "m", "level", "a", (F.col("s") + F.col("m") - F.expr("shiftleft(1, level)")).alias("idx")))
    named = saved(left.join(ranks, ["_row", "idx"]).withColumn("b", _at_level(F.col("level"), depth)).where("b is not null")
                  .select("_row", "doc", "s", "m", "a", "b"), "line-windows")
    place = F.struct("doc", "_row", "s")
    first = named.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = (named.join(first, ["m", "a", "b"]).where(place != F.col("first"))
             .groupBy("_row", F.col("s").alias("idx")).agg(F.max(F.col("s") + F.col("m")).alias("reach")))
    covered = F.max("reach").over(Window.partitionBy("_row").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return (active.select("_row", "idx", "pos").join(later, ["_row", "idx"], "left")
            .withColumn("covered", covered).where(F.col("covered") > F.col("idx")).select("_row", "pos"))


def line_deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and the counts _n_lines and _n_deleted.

    One row per input row, other columns as they are.  The copy that stays is the first by
    doc_id (null first), then row.  Blank lines are no part of a run and stay.  A null text
    stays null, an empty one empty; repeated rows are copies like any other; an empty table
    gives an empty result.
    """
    base = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "line-docs")
    gone = (deleted_lines(base.select("_row", "doc_id", F.col("text").cast("string")), min_words)
            .groupBy("_row").agg(F.collect_list("pos").alias("_gone")))
    parts = F.split("text", "\n", -1)
    # the text is split once, outside of the lambda
    rebuilt = base.join(gone, "_row", "left").withColumn("_parts", F.when(F.col("_gone").isNotNull(), parts))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr(
        "array_join(transform(array_except(sequence(0, size(_parts) - 1), _gone), p -> _parts[p]), '\\n')"))
    n = F.expr("size(filter(split(text, '\\n', -1), x -> trim(x) <> ''))")
    counted = rebuilt.withColumn("_n_lines", F.when(F.col("text").isNull(), 0).otherwise(n).cast("bigint"))
    return (counted.withColumn("text", text).withColumn("_n_deleted", F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"))
            .select(*docs.columns, "_n_lines", "_n_deleted"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of line runs, and without the documents of which every non-blank line was deleted."""
    done = line_deduplicated(docs, min_words)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.where("_n_deleted = 0 or _n_deleted < _n_lines").select(*docs.columns)
