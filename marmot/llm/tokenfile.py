"""Token-id output: independent zstandard frames, a trailing seek table, per-frame checksums.

File layout (little-endian), all of it readable as zstandard data:

* data frames, each with at most FRAME_IDS unsigned 32-bit ids and its own checksum;
* a skippable frame (0x184D2A50) with the document index: count, then per document
  its id (signed 64-bit; NULL_ID for null) and the end of its ids (unsigned 64-bit), in order;
* a skippable frame (0x184D2A5E) with the seek table of the public seekable format:
  per frame compressed size, size and checksum (low 32 bits of XXH64), then the number of
  frames, a flag byte (128: checksums there) and the magic 0x8F92EAB1.

A reader fetches the seek table from the file's end, the index before it, and then only
the frames that hold the documents asked for.  Files are opened through ``pyarrow.fs``,
so the shared folder may be any store it knows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marmot.llm.common import prepare, rows, saved
from marmot.llm.tokens import encoder

# fixed values of the seekable format
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX, WITH_CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 128
FRAME_IDS = 1 << 16
NULL_ID = -(2**63)


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Append documents in order; ``close`` adds the index and the seek table."""

    def __init__(self, out):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting = bytearray()
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting += ids
        self.total += len(ids) // 4
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.ends.append(self.total)
        while len(self.waiting) >= 4 * FRAME_IDS:
            self._frame(bytes(self.waiting[: 4 * FRAME_IDS]))
            del self.waiting[: 4 * FRAME_IDS]

    def _frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        index = np.array(self.ids, dtype="<i8").tobytes() + np.array(self.ends, dtype="<u8").tobytes()
        # a skippable frame holds less than 4 GB, that is 268 million documents: files have far fewer (see the writer)
        self.out.write(struct.pack("<IIQ", SKIP_INDEX, len(index) + 8, len(self.ids)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.seek)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.seek), WITH_CHECKSUMS, SEEK_MAGIC))


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3)
        self.packed, self.size, self.check = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        head = int(self.at[-1])
        magic, _, docs = struct.unpack("<IIQ", self.file.read_at(16, head))
        if magic != SKIP_INDEX:
            raise ValueError(f"{uri}: no document index")
        index = self.file.read_at(16 * docs, head + 16)
        self.ids = np.frombuffer(index, dtype="<i8", count=docs)
        self.ends = np.frombuffer(index, dtype="<u8", offset=8 * docs, count=docs).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])[:docs]
        self.cache: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def frame(self, i: int) -> bytes:
        if self.cache[0] != i:
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.packed[i]), int(self.at[i])), max_output_size=int(self.size[i]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.check[i]:
                raise ValueError(f"frame {i} is damaged")
            self.cache = (i, data)
            self.frames_read += 1
        return self.cache[1]

    def document(self, place: int) -> bytes:
        """The ids, as bytes, of the document at a place in the file; only its frames are decompressed."""
        s, e = 4 * int(self.starts[place]), 4 * int(self.ends[place])
        out = []
        i = int(np.searchsorted(self.begin, s, "right")) - 1
        while s < e:
            stop = min(e, int(self.begin[i + 1]))
            out.append(self.frame(i)[s - int(self.begin[i]) : stop - int(self.begin[i])])
            s, i = stop, i + 1
        return b"".join(out)

    def find(self, doc_ids: Iterable[int]) -> dict[int, bytes]:
        """The documents asked for that are there; ids are in ascending order, so each is a binary search."""
        out = {}
        for d in doc_ids:
            k = int(np.searchsorted(self.ids, d))
            if k < len(self.ids) and self.ids[k] == d:
                out[d] = self.document(k)
        return out

    def close(self) -> None:
        self.file.close()


MANIFEST = "part bigint, file string, n_docs bigint, n_tokens bigint"


def _writer(folder: str, tokenizer: str, lower: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, stop = encoder(tokenizer, lower), struct.pack("<I", end)
        store, path = _open(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"  # another name for each attempt; the manifest holds those that ended
        out = writer = None
        for batch in rows(batches):
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                writer = Writer(out)
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                writer.add(d, ids + stop)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)]), pa.array([writer.total])],
                                             names=["part", "file", "n_docs", "n_tokens"])
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, lower: bool, end: int) -> DataFrame:
    """Write every text's ids and the end id into files under ``folder``, ascending by doc_id over files and within.

    Returns the manifest (part, file, n_docs, n_tokens), written once, so the files are too.  Null doc_ids
    come first, rows of one doc_id in the order of their texts; a null text is empty and has the end id only.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # files grow with the input
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(dealt.mapInArrow(_writer(folder, tokenizer, lower, end), MANIFEST), "token-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        for base, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = Reader(file)
            for k in range(0, len(r.ids), 10_000):
                place = range(k, min(len(r.ids), k + 10_000))
                crc = [zlib.crc32(r.document(i)) for i in place]
                ids = r.ids[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(base + r.starts[k : k + 10_000]),
                     pa.array(r.ends[k : k + 10_000] - r.starts[k : k + 10_000]), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
            r.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    # one row per file: the running sum in one task is bounded by the number of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select(F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "file")
    return based.repartition(max(1, manifest.count())).mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
