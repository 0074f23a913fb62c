"""Best-fit packing by a grouping genetic algorithm.

Texts become token ids and an end id; only what is longer than a sequence is cut,
so that all pieces but the first are whole sequences.  The shorter pieces are dealt
by a hash to shards of about SHARD pieces.  On each shard several islands evolve
packings of its pieces; a packing's genes are its whole sequences (groups):

* crossover injects well-filled sequences of one parent into the other, removes the
  sequences that now hold a piece twice, and best-fits the displaced pieces;
* mutation dissolves the emptiest sequences and best-fits their pieces;
* fitness is the number of sequences, then the mean square of their filling;
* an island evolves until it meets the lower bound or PATIENCE generations bring no better packing.

Between epochs every island's best packings migrate to the next island of its ring
(a shuffle by shard and island).  Shards bound the memory of a task at any input size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import prepare, rows, saved
from marmot.llm.tokens import encoder

CAPACITY = 2048
SHARD, ISLANDS, EPOCHS = 8192, 2, 2
POPULATION, ELITE = 8, 2
#: generations without a better packing after which an island rests until the next epoch
PATIENCE = 24

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cutter(tokenizer: str, lower: bool, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stop = encoder(tokenizer, lower), np.array([end], dtype="<u4").tobytes()
        for batch in rows(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                ids += stop
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                for k, s in enumerate([0, *range(first, n, capacity)]):
                    e = first if k == 0 else s + capacity
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str, lower: bool, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of every row; a null text is the end id alone."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_cutter(tokenizer, lower, end, capacity), PIECES)


# ------------------------------------------------------------------ the genetic algorithm on one shard
class Rooms:
    """Open sequences by free room, with a bit set of the rooms that occur: best fit without a search."""

    def __init__(self, room: np.ndarray, capacity: int):
        self.by_room: dict[int, list[int]] = {}
        self.bits, self.capacity, self.n = 0, capacity, len(room)
        for b, r in enumerate(room.tolist()):
            if r:
                self._put(b, r)

    def _put(self, b: int, r: int) -> None:
        at = self.by_room.get(r)
        if at:
            at.append(b)
        else:
            self.by_room[r] = [b]
            self.bits |= 1 << r

    def place(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = self.by_room[r]
            b = at.pop()
            if not at:
                self.bits ^= 1 << r
        else:
            r, b = self.capacity, self.n
            self.n += 1
        if r > size:
            self._put(b, r - size)
        return b


def best_fit(of: np.ndarray, sizes: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Put the pieces ``loose`` into the packing ``of`` (piece -> sequence, -1: none), given largest first."""
    n = int(of.max(initial=-1)) + 1
    kept = of >= 0
    room = capacity - np.bincount(of[kept], weights=sizes[kept], minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    rooms = Rooms(room, capacity)
    of[loose] = [rooms.place(s) for s in sizes[loose].tolist()]
    return of


def fitness(of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(of, weights=sizes) / capacity
    return -len(fill), float(np.mean(fill * fill))


def _compact(of: np.ndarray) -> np.ndarray:
    kept = of >= 0
    out = np.full(len(of), -1, dtype=np.int64)
    out[kept] = np.unique(of[kept], return_inverse=True)[1]
    return out


def _largest_first(loose: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return loose[np.argsort(-sizes[loose], kind="stable")]


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Sequences of ``b``, the fuller the likelier, injected into ``a``."""
    fill = np.bincount(b, weights=sizes) / capacity
    chosen = rng.random(len(fill)) < 0.25 * fill**8
    inside = chosen[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[inside]] = True
    child = np.where(broken[a], -1, a)
    child[inside] = b[inside] + len(broken)
    child = _compact(child)
    return best_fit(child, sizes, _largest_first(np.flatnonzero(child < 0), sizes), capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(a, weights=sizes) / capacity
    dissolved = rng.random(len(fill)) < np.where(fill < 0.999, 0.3 * (1 - fill) + 0.05, 0.0)
    child = _compact(np.where(dissolved[a], -1, a))
    loose = np.flatnonzero(child < 0)
    noise = sizes[loose] * (1 + 0.1 * rng.random(len(loose)))
    return best_fit(child, sizes, loose[np.argsort(-noise, kind="stable")], capacity)


def start_population(sizes: np.ndarray, capacity: int, rng: np.random.Generator, n: int) -> list[np.ndarray]:
    """Best fit of the pieces in decreasing size, and of perturbed orders."""
    out = []
    for k in range(n):
        key = sizes * (1 + (0.15 * k / n) * rng.random(len(sizes)))
        out.append(best_fit(np.full(len(sizes), -1, dtype=np.int64), sizes, np.argsort(-key, kind="stable"), capacity))
    return out


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Generations of a crossover and a mutation each, until no packing can have fewer sequences or PATIENCE
    generations in a row brought none with fewer or fuller ones; the worst packings go. Best first."""
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(p, sizes, capacity), -i, p) for i, p in enumerate(population)), key=lambda x: x[:2], reverse=True)[:POPULATION]
    born, idle = len(population), 0
    while -scored[0][0][0] > least and idle < PATIENCE:
        best = scored[0][0]
        i, j = rng.choice(len(scored), 2, replace=len(scored) < 2)
        child = crossover(scored[min(i, j)][2], scored[max(i, j)][2], sizes, capacity, rng)
        for new in (child, mutate(scored[int(rng.integers(len(scored)))][2], sizes, capacity, rng)):
            scored.append((fitness(new, sizes, capacity), -born, new))
            born += 1
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:POPULATION]
        idle = 0 if scored[0][0] > best else idle + 1
    return [p for _, _, p in scored]


PACKINGS = "shard bigint, island int, sequences int, packing array<int>"


def _island(epoch: int, capacity: int):
    def run(key, items: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(x) for x in key)
        items = items.sort_values(["length", "uid"], kind="stable")
        sizes = items["length"].to_numpy(np.int64)
        if not len(sizes):
            return pd.DataFrame({"shard": [], "island": [], "sequences": [], "packing": []})
        rng = np.random.default_rng([shard, island, epoch])
        population = [np.asarray(p, dtype=np.int64) for p in arrived.sort_values(["origin", "rank"])["packing"]] if len(arrived) else []
        population = population or start_population(sizes, capacity, rng, POPULATION)
        best = evolve(population, sizes, capacity, rng)
        return pd.DataFrame({"shard": shard, "island": island, "sequences": [int(p.max()) + 1 for p in best],
                             "packing": [p.astype(np.int32) for p in best]})
    return run


def _assign(capacity: int):
    def run(key, items: pd.DataFrame, packings: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "uid"], kind="stable").reset_index(drop=True)
        sizes = items["length"].to_numpy(np.int64)
        if not len(sizes):
            return pd.DataFrame({"uid": [], "sequence_id": [], "offset": []})
        found = [np.asarray(p, dtype=np.int64) for p in packings.sort_values(["sequences", "island"])["packing"]]
        of = max(found, key=lambda p: fitness(p, sizes, capacity))
        order = np.argsort(of, kind="stable")
        total = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(of[order]) > 0])
        offset = np.empty(len(of), dtype=np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        return pd.DataFrame({"uid": items["uid"], "sequence_id": int(key[0]) * 2**32 + of, "offset": offset})
    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a length of 1 to ``capacity``) with sequence_id and offset.

    Every row is placed once, sequences have no gaps; an empty table gives an empty one.
    Full pieces are sequences of their own.
    """
    # row numbers are fixed by writing the rows once
    fixed = saved(parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    small = fixed.where(F.col("length") < capacity).select("uid", "length")
    n = small.count()
    shards = max(1, -(-n // SHARD))
    items = small.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    spread = saved(items.select("shard", "uid", "length", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")), "islands")
    schema = "shard bigint, island int, sequences int, origin int, rank int, packing array<int>"
    arrived = fixed.sparkSession.createDataFrame([], schema)
    for epoch in range(EPOCHS):
        evolved = saved(spread.groupBy("shard", "island").cogroup(arrived.groupBy("shard", "island"))
                        .applyInPandas(_island(epoch, capacity), PACKINGS), "packings")
        ranked = evolved.selectExpr("shard", "island as origin", "sequences", "packing",
                                    "row_number() over (partition by shard, island order by sequences, hash(packing)) as rank")
        # an island keeps its packings, and its best also go to the next one of the ring
        goes = ranked.where(F.col("rank") <= ELITE).withColumn("island", F.pmod(F.col("origin") + 1, F.lit(ISLANDS)))
        stays = ranked.withColumn("island", F.col("origin"))
        arrived = stays.unionByName(goes).distinct() if ISLANDS == 1 else stays.unionByName(goes)
        arrived = arrived.select("shard", "island", "sequences", "origin", "rank", "packing")
    placed = (items.groupBy("shard").cogroup(evolved.groupBy("shard"))
              .applyInPandas(_assign(capacity), "uid bigint, sequence_id bigint, offset bigint"))
    full = (fixed.where(F.col("length") >= capacity)
            .withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("bigint")))
    return fixed.where(F.col("length") < capacity).join(placed, "uid").unionByName(full).drop("uid")
