"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes its set of word shingles (64-bit fingerprints), 256
   MinHash minima of it, their low 2 bits packed into eight longs, and 42 band
   keys of 6 minima each.  At similarity 0.8 a pair shares no band with
   probability 3e-6.
2. Documents with one and the same set are one node (128-bit set digest and size).
3. In each band bucket every node meets up to four hubs of the bucket.  Of all hubs it has
   met it is paired with the four that it shares most buckets with; a pair goes on if the
   collision-corrected similarity of the packed signatures, estimated by bit counts, is
   within six standard errors of the threshold.  Each node's best pair is confirmed on full
   sets, and the links are joined into components.  Buckets that then still hold nodes of
   several components go the same way once more, with hubs of different components.
4. Buckets whose nodes now all belong to one component need nothing more: a large
   group of copies costs a few pairs per copy.  In the other buckets the nodes that pass
   the estimate with one of another component get their full sets, and every such pair is
   confirmed on them.  Estimate and confirmation are join conditions, so rejected pairs
   are never rows, also where a whole group lies just below the threshold.

Confirmed links are exactly ``100 * |A & B| >= 80 * |A | B|``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marmot.llm.common import NOT_SPACE, prepare, hashed_words, lowered, mix64, rows, saved, shingles
from marmot.llm.components import components

PERMS, BANDS, ROWS, BITS = 256, 42, 6, 2
#: nodes of a bucket that its other nodes are compared with first
HUBS = 4
#: hubs that a node is paired with: those it shares most buckets with
NEAREST = 4
#: six standard errors of the corrected estimate at the threshold
SLACK = 0.18
CHUNK = 1 << 15
_EVEN_BITS = 0x5555555555555555

SIG_SCHEMA = "doc_id bigint, n_shingles bigint, key_hi bigint, key_lo bigint, sig array<bigint>, bands array<bigint>"
SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_hi", pa.int64()), ("key_lo", pa.int64()),
                       ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _perms() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(1, 2**32, PERMS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, PERMS, dtype=np.uint32))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash minima, one row per (non-empty) set, one column per permutation."""
    a, b = _perms()
    out = np.empty((len(sets), PERMS), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= CHUNK):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        v = np.empty_like(x)
        for p in range(PERMS):
            np.multiply(x, a[p], out=v)
            np.add(v, b[p], out=v)
            out[i:j, p] = np.minimum.reduceat(v, starts)
        i = j
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Low bits of the (mixed) minima, 32 of them to a long."""
    m = mins ^ (mins >> np.uint32(16))
    m = m * np.uint32(0x7FEB352D)
    m ^= m >> np.uint32(15)
    low = (m & np.uint32(3)).astype(np.uint64).reshape(len(m), PERMS // 32, 32)
    shifts = (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low << shifts, axis=2).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        acc = mix64(acc ^ (m[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
    return acc.view(np.int64)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    words, bounds = hashed_words(texts, NOT_SPACE)
    return [np.unique(shingles(words[bounds[i] : bounds[i + 1]], k)) for i in range(len(texts))]


def _lists(matrix: np.ndarray, valid: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as list values at the valid places, null elsewhere."""
    width = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(valid, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)), mask=pa.array(~valid)) if n else pa.array([], pa.list_(pa.int64()))


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            sets = shingle_sets(lowered(batch.column(1)), k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = n > 0
            some = [s for s in sets if len(s)]
            mins = minima(some) if some else np.zeros((0, PERMS), dtype=np.uint32)
            hi, lo = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    hi[i] = np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                    lo[i] = np.add.reduce(mix64(s + np.uint64(0x1234567)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                 _lists(packed(mins), full, len(sets)), _lists(band_keys(mins), full, len(sets))], schema=SIG_ARROW)
    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set digest, packed signature, band keys); the last two are null for an empty text."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_signer(k), SIG_SCHEMA)


#: bits of the map that lets a scan skip documents nobody asks for; a full map skips none
MAP_BITS = 1 << 22


def _id_map(ids: DataFrame) -> np.ndarray:
    """Bits set at the hashes of the ids (column ``id``): at most MAP_BITS / 64 words reach the driver."""
    slot = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    words = (ids.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {MAP_BITS}) & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def _set_maker(k: int, map_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = map_var.value
        for batch in rows(batches):
            slot = batch.column(2).to_numpy()
            wanted = np.flatnonzero(asked[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
            if not len(wanted):
                continue
            sets = shingle_sets(lowered(batch.column(1).take(pa.array(wanted))), k)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(wanted)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))],
                names=["id", "set"])
    return run


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, set): the full shingle sets of the asked documents.  Texts are not shuffled: the scan
    skips by the map of asked ids, and what it lets through by chance goes in a join of sets."""
    ids = saved(ids.distinct(), "minhash-asked")
    map_var = docs.sparkSession.sparkContext.broadcast(_id_map(ids))
    made = (docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
            .withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)))
            .mapInArrow(_set_maker(k, map_var), "id bigint, set array<bigint>"))
    return saved(made.join(ids, "id", "left_semi"), "minhash-sets")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: agreeing values by bit counts, corrected for chance agreement."""
    differing = F.expr(f"""aggregate(zip_with({a}, {b}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {_EVEN_BITS}L)),
                           0, (s, c) -> s + c)""")
    chance = 2.0**-BITS
    return ((PERMS - differing) / F.lit(float(PERMS)) - chance) / (1 - chance)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and what else they carry) whose full shingle sets are similar enough, written."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
                 .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))
    return saved(both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
                 .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("i")))
                 .select(*pairs.columns), "minhash-links")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs of different components, with them as ca and cb."""
    ca = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return (pairs.join(ca, "a", "left").join(cb, "b", "left")
            .withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after further links between components (ca, cb): only the graph of components is searched."""
    more = components(links.select("ca", "cb"), "ca", "cb")
    moved = (comps.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
             .select("node", F.coalesce("to", "component").alias("component")))
    return saved(moved.unionByName(more.join(comps.select("node"), "node", "left_anti")), "minhash-comps")


def _close(na: str, nb: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)


def _passing(threshold: float, percent: int) -> Column:
    """Whether rows x and y of a bucket, of different components, may be linked by the estimate."""
    return ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & _close("x.n", "y.n", percent)
            & (estimate("x.sig", "y.sig") >= threshold - SLACK))


def _hub_pairs(members: DataFrame, lean: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node's likeliest link with a hub of another component, of ``members`` (bucket, rep, comp).

    A bucket has up to HUBS hubs, each the least node of some of its components.  A node goes
    to the estimate with NEAREST of the hubs it meets at most, so pairs grow with the nodes,
    whatever the size of a group and the number of buckets that it falls into.
    """
    hubs = (members.groupBy("bucket", F.pmod(F.xxhash64("comp"), F.lit(HUBS)).alias("slot"))
            .agg(F.min(F.struct(F.col("comp").alias("hub_comp"), F.col("rep").alias("hub"))).alias("h")).select("bucket", "h.*"))
    met = members.join(hubs, "bucket").where("comp <> hub_comp").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("buckets"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("buckets"), "hub"))  # a node's few hundred hubs at most
    met = (met.withColumn("place", place).where(F.col("place") <= NEAREST)
           .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    star = saved(met.join(lean.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga")), "a")
                 .join(lean.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb")), "b")
                 .where(_close("na", "nb", percent)).select("a", "b", estimate("siga", "sigb").alias("est"))
                 .where(F.col("est") >= percent / 100.0 - SLACK), "minhash-star")
    ends = star.withColumn("x", F.col("a")).unionByName(star.withColumn("x", F.col("b")))
    best = ends.groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    return saved(best, "minhash-best")


def _open(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, rep, comp): the nodes of the buckets that hold several components."""
    tagged = (shared.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
              .select("bucket", "rep", F.coalesce("component", "rep").alias("comp")))
    still = tagged.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return tagged.join(still, "bucket")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are
    runs of non-space characters after lower-casing A-Z; a text of fewer than
    ``k`` words is one shingle.  A null or blank text has an empty set and is
    its own component.  A row with a null ``doc_id`` links with nothing and has
    a null component and ``kept`` true.  Rows that share a doc_id are one
    document: links of any of their texts are its links.  An empty table gives
    an empty result.
    """
    threshold = percent / 100.0
    sigs = saved(signatures(docs, k), "minhash-sig")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("key_hi", "key_lo", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"))
    reps = saved(reps, "minhash-reps")
    nodes = saved(full.join(reps.select("key_hi", "key_lo", F.col("rep").alias("doc_id"), "n"), ["key_hi", "key_lo", "doc_id"])
                  .dropDuplicates(["doc_id", "key_hi", "key_lo"])
                  .select(F.col("doc_id").alias("rep"), "n", "sig", "bands"), "minhash-nodes")
    # buckets of two nodes or more
    members = nodes.select("rep", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    shared = saved(members.join(crowded, "bucket"), "minhash-buckets")
    lean = nodes.select("rep", "n", "sig")
    # most nodes of a group need no other pair than one with a hub
    best = _hub_pairs(shared.withColumn("comp", F.col("rep")), lean, percent)
    sets = _sets(best.select(F.explode(F.array("a", "b")).alias("id")), docs, k)
    comps = components(_verified(best, sets, percent))
    # hubs of one group can lead to several components: in their buckets, a round with one hub of a component
    best = _hub_pairs(_open(shared, comps), lean, percent)
    if not best.isEmpty():
        sets = _sets(best.select(F.explode(F.array("a", "b")).alias("id")), docs, k)
        comps = _joined(comps, _verified(_apart(best, comps), sets, percent))
    # what the hubs did not settle
    still = saved(_open(shared, comps).join(lean, "rep"), "minhash-open")
    x, y = still.alias("x"), still.alias("y")
    able = saved(x.join(y, _passing(threshold, percent) & (F.col("x.rep") != F.col("y.rep")), "left_semi"), "minhash-able")
    more = _sets(able.select(F.col("rep").alias("id")), docs, k)
    able = saved(able.join(nodes.select("rep", "bands").join(more.withColumnRenamed("id", "rep"), "rep"), "rep"), "minhash-full")
    x, y = able.alias("x"), able.alias("y")
    both = F.size(F.array_intersect("x.set", "y.set"))
    # sets are compared only where the estimate passes, and in the first bucket that holds both
    same = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true)")
    here = F.element_at("x.bands", same.cast("int")) == F.col("x.bucket")
    linked = F.when(_passing(threshold, percent) & here, F.lit(100) * both >= F.lit(percent) * (F.col("x.n") + F.col("y.n") - both)).otherwise(F.lit(False))
    links = saved(x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & linked)
                  .select(F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct(), "minhash-links")
    comps = _joined(comps, links)
    # a document id with several texts is one document: its nodes are linked as well
    of_doc = saved(full.select("doc_id", "key_hi", "key_lo", F.col("n_shingles").alias("n"))
                   .join(reps, ["key_hi", "key_lo", "n"]).select("doc_id", "rep").distinct(), "minhash-docs")
    split = of_doc.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    own = of_doc.join(split.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    comps = _joined(comps, _apart(own, comps))
    of_doc = (of_doc.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
              .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
    out = sigs.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
