"""Shared helpers: table access, written intermediates, vectorised word hashing.

Texts are hashed in NumPy over the UTF-8 bytes of an Arrow batch: a word is a
maximal run of bytes of a byte class, its fingerprint a 64-bit polynomial over
randomised byte values.  Cost is a few array passes per byte, memory is bounded
by a piece of the batch, and the same words give the same fingerprints in every
task.  Two different words share a fingerprint with probability about 2**-64.
"""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marmot.session import scratch_path

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20240607


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Give the workers this package's code, and bound an Arrow batch: texts can be long, so few rows each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="marmot-code-")) / "marmot.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in root.rglob("*.py"):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate under the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- byte classes
def byte_class(pred) -> np.ndarray:
    return np.fromiter((pred(b) for b in range(256)), dtype=bool, count=256)


#: ``[^\x20\x09-\x0D]+`` over UTF-8 bytes
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z, everything beyond ASCII
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, powers of the base, powers of its inverse modulo 2**64."""
    rng = np.random.default_rng(_SEED)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    n = 2 * PIECE_BYTES + 1
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE, dtype=np.uint64)
        inverses = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
        powers[0] = inverses[0] = 1
        powers, inverses = np.cumprod(powers), np.cumprod(inverses)
    return values, powers, inverses


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _piece_words(buf: np.ndarray, word: np.ndarray, at: int, out: list) -> None:
    values, powers, inverses = _tables()
    inside = word[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    with np.errstate(over="ignore"):
        if len(buf) < len(powers):
            prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(values[buf] * powers[: len(buf)], out=prefix[1:])
            h = (prefix[ends] - prefix[starts]) * inverses[starts]
        else:  # one word longer than a piece: Horner over its bytes in fixed steps
            h = np.empty(len(starts), dtype=np.uint64)
            for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                acc, scale = np.uint64(0), np.uint64(1)
                for k in range(s, e, PIECE_BYTES):
                    part = values[buf[k : min(e, k + PIECE_BYTES)]]
                    acc += np.uint64((part * powers[: len(part)]).sum(dtype=np.uint64)) * scale
                    scale *= powers[min(len(part), PIECE_BYTES)]
                h[i] = acc
    out.append((mix64(h), starts + at, ends + at))


def hashed_words(texts: list[bytes | None], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of every text, one after another, and the texts' bounds in them."""
    joined = b"\n".join(t or b"" for t in texts)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=begins[1:])
    buf = np.frombuffer(joined, dtype=np.uint8)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + PIECE_BYTES)
        while end < n:  # cut where no word is cut
            cut = np.flatnonzero(~word[buf[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(n, end + PIECE_BYTES)
        _piece_words(buf[at:end], word, at, parts)
        at = end
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    hashes = np.concatenate([p[0] for p in parts])
    starts = np.concatenate([p[1] for p in parts])
    return hashes, np.searchsorted(starts, begins)


def lowered(column: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return [None if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all k-word shingles in order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        acc = words[: n - k + 1].copy()
        for j in range(1, k):
            acc *= np.uint64(_BASE)
            acc += words[j : n - k + 1 + j]
        return mix64(acc + np.uint64(k))


def ragged(pool: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the pool at the places, one after another, and where each ends."""
    n = count[place]
    ends = np.cumsum(n)
    return pool[np.repeat(start[place] - ends + n, n) + np.arange(int(n.sum()))], ends


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skip empty batches."""
    return (b for b in batches if b.num_rows)
