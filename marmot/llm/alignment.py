"""Cross-tokenizer alignment with corpus-wide counts of linked token ids.

1. Texts are cut at single spaces between words, where both vocabularies cut them anyway
   (no token of either crosses such a place), and every distinct piece is encoded by both
   and aligned once: its token ends on either side cut it into stretches, a stretch is a
   link, an end of both sides ends a group.  A text is its pieces one after another.
2. Every task radix-partitions its pair-document records (B id, A id, document, links) by
   B id and writes them as runs of zstandard frames under the shared folder: in a run
   a radix has a head (pairs in order, links and documents of each) and a body (document
   and links of each record).  A manifest, written once, names the runs of tasks that ended.
3. For each radix, one task merges the heads of all its runs by a heap and counts every
   pair.  The order is B id first, so all pairs of a B id come together and their
   maximum is known before the counts stream back to the runs.
4. For each run, one task reads the bodies beside the counts and adds them up by document.

No id is a hot key: a common pair is one head entry a run, and its records stay with the
documents they came from.  Memory is bounded by a run (RUN_RECORDS) and a buffer a merged run.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import prepare, rows, saved
from marmot.llm.tokenfile import _open

#: pieces a worker remembers; it starts again when full
MEMO = 300_000
#: records (before those of one document and pair are added up) that make a run
RUN_RECORDS = 3_000_000
#: pieces encoded and aligned together
STRIDE = 4_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_IDS = 1 << 17  # above any id of either vocabulary


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both vocabularies, and what is known of the pieces met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.spelled: list[str] = []  # the groups of a piece as text
        self.facts = np.zeros((1024, 4), dtype=np.int64)  # whether its bytes agree, A ids, B ids, groups
        self.pair_at = np.zeros(1025, dtype=np.int64)
        self.pairs = np.zeros(1 << 14, dtype=np.int64)  # the links of all pieces, B id above A id

    def _learn(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), STRIDE):
            self._learn_some(pieces[k : k + STRIDE])

    def _learn_some(self, pieces: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        sound = [b"".join([self.a_bytes[t] for t in x]) == b"".join([self.b_bytes[t] for t in y]) == b" " + p.encode() for p, x, y in zip(pieces, a, b, strict=True)]
        a = [x if ok else [] for x, ok in zip(a, sound, strict=True)]
        b = [x if ok else [] for x, ok in zip(b, sound, strict=True)]
        n_a, n_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
        ids_a, ids_b = (np.fromiter((t for x in side for t in x), dtype=np.int64, count=int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        cuts = np.union1d(ends_a, ends_b)  # a stretch between cuts lies in one token of either side
        both = np.isin(cuts, ends_a, assume_unique=True) & np.isin(cuts, ends_b, assume_unique=True)
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        size = np.array([len(p.encode()) + 1 if ok else 0 for p, ok in zip(pieces, sound, strict=True)], dtype=np.int64)
        stop = np.searchsorted(cuts, np.cumsum(size), "right")  # links up to each piece's end
        group_ends = np.concatenate([[0], np.cumsum(both)])
        n_groups = np.diff(group_ends[np.concatenate([[0], stop])])
        shared = cuts[both]
        a_at, b_at = np.searchsorted(ends_a, shared, "right"), np.searchsorted(ends_b, shared, "right")
        words_a, words_b = ids_a.astype(str).tolist(), ids_b.astype(str).tolist()
        text, la, lb = [], 0, 0
        for x, y in zip(a_at.tolist(), b_at.tolist(), strict=True):
            text.append(f"{','.join(words_a[la:x])}|{','.join(words_b[lb:y])}")
            la, lb = x, y
        first = len(self.spelled)
        n = len(pieces)
        while first + n >= len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.pair_at = np.concatenate([self.pair_at, np.zeros(len(self.pair_at) - 1, dtype=np.int64)])
        at = 0
        for p, g in zip(pieces, n_groups.tolist(), strict=True):
            self.place[p] = len(self.spelled)
            self.spelled.append(";".join(text[at : at + g]))
            at += g
        self.facts[first : first + n] = np.stack([np.array(sound, dtype=np.int64), n_a, n_b, n_groups], axis=1)
        used = int(self.pair_at[first])
        while used + len(cuts) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[used : used + len(cuts)] = ids_b[link_b] * _IDS + ids_a[link_a]
        self.pair_at[first + 1 : first + n + 1] = used + stop

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text (A ids, B ids, groups, links) and the digest of its groups; all links, and the text each is of."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        if len(self.spelled) > MEMO:
            self._forget()
        self._learn(list({p for c in cut for p in c if p not in self.place}))
        get = self.place.__getitem__
        places = [list(map(get, c)) for c in cut]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        flat = np.fromiter((k for p in places for k in p), dtype=np.int64, count=int(bounds[-1]))
        facts = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(self.facts[flat], axis=0)])
        sums = facts[bounds[1:]] - facts[bounds[:-1]]
        sound = sums[:, 0] == np.diff(bounds)
        of_text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        use = sound[of_text]
        flat, of_text = flat[use], of_text[use]
        starts, n = self.pair_at[flat], self.pair_at[flat + 1] - self.pair_at[flat]
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        doc = np.repeat(of_text, n)
        stats = np.zeros((len(texts), 4), dtype=np.int64)
        stats[:, :3] = np.where(sound[:, None], sums[:, 1:], 0)
        stats[:, 3] = np.bincount(doc, minlength=len(texts))
        spell = self.spelled.__getitem__
        digest = [hashlib.sha256(";".join(map(spell, p)).encode()).hexdigest() if p and ok else "" for p, ok in zip(places, sound.tolist(), strict=True)]
        return stats, digest, self.pairs[step], doc


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner, with its memo, for a worker process."""
    return Aligner(a_path, b_path)


# ---------------------------------------------------------------- runs
def _packed(z: zstandard.ZstdCompressor, *arrays: np.ndarray) -> bytes:
    """One frame: the arrays' lengths, then their bytes."""
    return z.compress(struct.pack(f"<{len(arrays)}q", *(len(x) for x in arrays)) + b"".join(x.tobytes() for x in arrays))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


HEAD, BODY = ("<i8", "<i8", "<i4"), ("<i4", "<i4")  # pair steps, links, documents; document, links
#: head entries of a frame: what a merge holds of a run
HEAD_ENTRIES = 1 << 14
MANIFEST = "run string, file string, radix int, head_at bigint, body_at bigint, body_size bigint, entries bigint"
DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class _Run:
    """What a task gathers until it is written as one run file."""

    def __init__(self) -> None:
        self.docs: list[pa.RecordBatch] = []
        self.n_docs = self.n_records = 0
        self.pairs: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, ids: pa.Array, stats: np.ndarray, digest: list[str], pairs: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((doc, pairs))
        pairs, doc = pairs[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])]) if len(pairs) else np.zeros(0, dtype=bool))
        self.pairs.append(pairs[first])
        self.owner.append((doc[first] + self.n_docs).astype(np.int32))
        self.links.append(np.diff(np.append(first, len(pairs))).astype(np.int32))
        self.docs.append(pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(stats[:, k]) for k in range(4)), pa.array(digest, pa.string())], names=list(DOCS)))
        self.n_docs += len(ids)
        self.n_records += len(first)

    def write(self, folder: str, radixes: int) -> list[tuple]:
        """Write the file; returns its rows of the manifest: one for every radix that has records, one (-1) for its documents."""
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        run = uuid.uuid4().hex  # another name for each attempt; the manifest holds those that ended
        name = f"run-{run}.zst"
        z = zstandard.ZstdCompressor(level=1)
        pairs, owner, links = (np.concatenate(x) for x in (self.pairs, self.owner, self.links))
        radix = (pairs // _IDS) % radixes
        order = np.lexsort((pairs, radix))  # stable: documents of a pair stay in order
        pairs, owner, links, radix = pairs[order], owner[order], links[order], radix[order]
        bounds = np.searchsorted(radix, np.arange(radixes + 1))
        manifest, at = [], 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for r in range(radixes):
                s, e = int(bounds[r]), int(bounds[r + 1])
                if s == e:
                    continue
                first = np.flatnonzero(np.concatenate([[True], pairs[s + 1 : e] != pairs[s : e - 1]])) + s
                heads = pairs[first]
                totals = np.add.reduceat(links[s:e], first - s, dtype=np.int64)
                n_docs = np.diff(np.append(first, e)).astype("<i4")
                head_at = at
                for k in range(0, len(heads), HEAD_ENTRIES):
                    piece = slice(k, k + HEAD_ENTRIES)
                    frame = _packed(z, np.diff(heads[piece], prepend=0).astype("<i8"), totals[piece].astype("<i8"), n_docs[piece])
                    out.write(struct.pack("<q", len(frame)) + frame)
                    at += 8 + len(frame)
                body = _packed(z, owner[s:e].astype("<i4"), links[s:e].astype("<i4"))
                out.write(body)
                manifest.append((run, f"{folder}/{name}", r, head_at, at, len(body), len(heads)))
                at += len(body)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, self.docs[0].schema) as w:
                for b in self.docs:
                    w.write_batch(b)
            docs = z.compress(sink.getvalue())
            out.write(docs)
            manifest.append((run, f"{folder}/{name}", -1, 0, at, len(docs), self.n_docs))
        return manifest


def _manifest_batch(entries: list[tuple]) -> pa.RecordBatch:
    run, file, radix, head_at, body_at, body_size, n = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(run), pa.array(file), pa.array(radix, pa.int32()), *(pa.array(x, pa.int64()) for x in (head_at, body_at, body_size, n))],
                                      names=[c.split()[0] for c in MANIFEST.split(", ")])


def _spiller(a_path: str, b_path: str, folder: str, radixes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held = aligner(a_path, b_path), _Run()
        for batch in rows(batches):
            held.add(batch.column(0), *both.align(batch.column(1).to_pylist()))
            if held.n_records >= RUN_RECORDS:
                yield _manifest_batch(held.write(folder, radixes))
                held = _Run()
        if held.n_docs:
            yield _manifest_batch(held.write(folder, radixes))
    return run


def spill(docs: DataFrame, folder: str, a_path: str, b_path: str, radixes: int) -> DataFrame:
    """Align every text and write its records as runs under ``folder``; the manifest, written once."""
    prepare(docs.sparkSession, 250)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(plain.mapInArrow(_spiller(a_path, b_path, folder, radixes), MANIFEST), "alignment-runs")


# ---------------------------------------------------------------- merging
def _heads(file, at: int, entries: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The frames of a head: pairs, links, documents."""
    while entries > 0:
        size = struct.unpack("<q", file.read_at(8, at))[0]
        steps, totals, n_docs = _unpacked(file.read_at(size, at + 8), *HEAD)
        yield np.cumsum(steps), totals, n_docs
        at, entries = at + 8 + size, entries - len(steps)


def _stream(file: str, at: int, entries: int, which: int) -> Iterator[tuple[int, int, int]]:
    """(pair, links, number of the run) in the order of the pairs; the file is closed between frames, so that many runs can be merged."""
    while entries > 0:
        store, path = _open(file)
        with store.open_input_file(path) as f:
            size = struct.unpack("<q", f.read_at(8, at))[0]
            steps, totals, _ = _unpacked(f.read_at(size, at + 8), *HEAD)
        at, entries = at + 8 + size, entries - len(steps)
        for pair, n in zip(np.cumsum(steps).tolist(), totals.tolist(), strict=True):
            yield pair, n, which


#: counts that wait before they are sent back to their runs
SEND = 1 << 20
COUNTED = "run string, file string, radix int, part int, counts binary, best binary"


def _merge(radix: int, runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Count the pairs of a radix over its runs; every run gets its pairs' counts, in its order, and whether they are their B id's highest."""
    counts: list[list[int]] = [[] for _ in runs]
    best: list[list[bool]] = [[] for _ in runs]
    waiting, part = 0, 0
    side: list[tuple[int, list[int]]] = []  # pairs of one B id: count, the runs that have it

    def settle() -> None:
        nonlocal waiting
        top = max(n for n, _ in side)
        for n, having in side:
            for k in having:
                counts[k].append(n)
                best[k].append(n == top)
            waiting += len(having)
        side.clear()

    def send() -> pa.RecordBatch:
        nonlocal waiting
        full = [k for k, c in enumerate(counts) if c]
        out = pa.RecordBatch.from_arrays(
            [pa.array([runs[k][0] for k in full]), pa.array([runs[k][1] for k in full]), pa.array([radix] * len(full), pa.int32()), pa.array([part] * len(full), pa.int32()),
             pa.array([np.array(counts[k], dtype="<i8").tobytes() for k in full], pa.binary()), pa.array([np.array(best[k], dtype="u1").tobytes() for k in full], pa.binary())],
            names=[c.split()[0] for c in COUNTED.split(", ")])
        for k in full:
            counts[k], best[k] = [], []
        waiting = 0
        return out

    last = -1
    for pair, n, k in heapq.merge(*(_stream(file, at, entries, k) for k, (_, file, at, entries) in enumerate(runs))):
        if pair != last:
            if side and pair // _IDS != last // _IDS:
                settle()
                if waiting >= SEND:
                    yield send()
                    part += 1
            side.append((0, []))
            last = pair
        side[-1] = (side[-1][0] + n, side[-1][1])
        side[-1][1].append(k)
    if side:
        settle()
    if waiting:
        yield send()


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a radix come together."""
    radix, runs = None, []
    for b in rows(batches):
        for run, file, r, at, entries in zip(*(b.column(c).to_pylist() for c in ("run", "file", "radix", "head_at", "entries")), strict=True):
            if r != radix and runs:
                yield from _merge(radix, runs)
                runs = []
            radix = r
            runs.append((run, file, at, entries))
    if runs:
        yield from _merge(radix, runs)


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(docs: pa.Table, best: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    t = docs.combine_chunks()
    yield from pa.table([*(t[c] for c in DOCS[:5]), pa.array(best), pa.array(total), t["groups_sha256"]],
                        names=[c.split()[0] for c in RESULT.split(", ")]).to_batches(max_chunksize=10_000)


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a run come together: its documents (radix -1), then by radix its manifest row and the counts in parts."""
    file = docs = best = total = n_docs = owner = links = None
    at = 0

    def done() -> Iterator[pa.RecordBatch]:
        if file is not None:
            file.close()
            yield from _finish(docs, best, total)

    for b in rows(batches):
        columns = ("file", "radix", "part", "head_at", "body_at", "body_size", "entries", "counts", "best")
        for name, radix, part, head_at, body_at, size, entries, counts, tops in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if radix == -1:
                yield from done()
                store, path = _open(name)
                file = store.open_input_file(path)
                docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(file.read_at(size, body_at))).read_all()
                best, total = np.zeros(docs.num_rows, dtype=np.int64), np.zeros(docs.num_rows, dtype=np.int64)
            elif part == -1:
                owner, links = _unpacked(file.read_at(size, body_at), *BODY)
                n_docs, at = np.concatenate([x[2] for x in _heads(file, head_at, entries)]), 0
                seen = 0  # head entries whose counts have come
            else:
                value = np.frombuffer(counts, dtype="<i8")
                top = np.frombuffer(tops, dtype="u1")
                width = n_docs[seen : seen + len(value)]
                seen += len(value)
                upto = at + int(width.sum())
                d, n = owner[at:upto], links[at:upto].astype(np.int64)
                np.add.at(total, d, n * np.repeat(value, width))
                np.add.at(best, d, n * np.repeat(top, width))
                at = upto
    yield from done()


def alignment(docs: DataFrame, folder: str, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty texts, and texts that either side
    does not give back byte by byte, have zeros and an empty digest and link nothing.  A null or repeated doc_id
    is no key here: every row is counted and returned.  An empty table gives an empty result.  ``folder`` must be
    shared by all executors; the runs stay there.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = spill(docs, folder, a_path, b_path, radixes=4 * width)
    heads = manifest.where("radix >= 0")
    counted = (heads.repartition("radix").sortWithinPartitions("radix", "run").mapInArrow(_merger, COUNTED))
    counted = saved(counted, "alignment-counts")
    none = F.lit(None).cast("binary")
    rows_of = manifest.select("run", "file", "radix", F.lit(-1).alias("part"), "head_at", "body_at", "body_size", "entries", none.alias("counts"), none.alias("best"))
    sent = counted.select("run", "file", "radix", "part", *(F.lit(0).cast("bigint").alias(c) for c in ("head_at", "body_at", "body_size", "entries")), "counts", "best")
    return rows_of.unionByName(sent).repartition("run").sortWithinPartitions("run", "radix", "part").mapInArrow(_adder, RESULT)
