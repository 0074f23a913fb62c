"""Token ids of whole texts, by the tokenizers library with a memo of encoded pieces.

A text is cut before every space that follows a non-space and each piece encoded
on its own: both vocabularies split text so that no token crosses such a place,
hence the ids of the pieces, one after another, are the ids of the text (tested
against the library on whole texts).  A piece seen before comes from a bounded
per-worker memo; a text in which a space lies between white space is encoded whole.

For the vocabulary that keeps white space the memo is an Arrow array over an array of
ids, asked for a batch's distinct pieces at once.  It holds parts of pieces: a run of
letters, and what follows it, are encoded on their own there, as no token crosses from
the one to the other, nor from a line end to what is no white space.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marmot.llm.common import ragged

#: entries of a generation of a worker's memo, about 60 MB; when it is full it becomes the old one, and what
#: of that is asked for again moves on: common pieces are never forgotten
MEMO = 300_000
#: texts that are looked up together
STRIDE = 100
#: characters of texts that are looked up together in a vocabulary with white space, and parts in its memo, about 50 bytes each
CHUNK, KNOWN = 1 << 20, 300_000
#: bytes of letters (1, or beyond ASCII), marks (2) and a line end (3)
_PART_KIND = np.array([1 if b >= 0x80 or chr(b).isalpha() else 3 if b == 0x0A else 2 if 0x21 <= b <= 0x7E and not chr(b).isdigit() else 0
                       for b in range(256)], dtype=np.uint8)
#: byte-level vocabularies write the bytes that are no printable Latin-1 as the letters from 256 on, in order
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_PUNCTUATION = ".,;:!?*#$%&)]}\"|"
_SPACE_THEN = re.compile(r" (?:\s|\Z)")
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values()))
        self.lower = lower  # the vocabulary ignores case, so the memo may too
        self.memo: dict[str, bytes] = {}  # of pieces that follow a space
        self.old: dict[str, bytes] = {}  # the generation before
        self.tails: dict[str, bytes] = {}  # of punctuation that follows letters

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _flat(text: str) -> str:
        flat = text.replace("\n", " ")
        return text if _SPACE_THEN.search(flat) and _INNER_SPACE.search(flat) else flat

    def _learn(self, pieces: set[str]) -> None:
        """Put the pieces into the memo: from the old one, as letters and the punctuation after them (tokens of their own), or asked for."""
        memo, old, tails, tokenize = self.memo, self.old, self.tails, self.tokenizer.model.tokenize
        space = "" if self.lower else chr(_BYTE_LETTERS[0x20])
        others, joined = [], []
        for p in pieces:
            ids = old.get(p)
            if ids is not None:
                memo[p] = ids
                continue
            core = p.rstrip(_PUNCTUATION)
            if not core.isalpha():
                others.append(p)
                continue
            start = memo.get(core) or old.get(core)
            if start is None:
                # letters after a space are one word to either vocabulary; if its normaliser leaves them as they are, ask its model
                if core.isascii() and (not self.lower or core.islower()):
                    start = memo[core] = array("I", [t.id for t in tokenize(space + core)]).tobytes()
                elif not self.lower or core == core.lower() and unicodedata.is_normalized("NFC", core):
                    word = core.encode().decode("latin-1").translate(_BYTE_LETTERS)
                    start = memo[core] = array("I", [t.id for t in tokenize(space + word)]).tobytes()
                else:
                    others.append(core)
            if len(core) < len(p):
                tail = tails.get(p[len(core):])
                if start is None or tail is None:
                    joined.append((p, core))
                else:
                    memo[p] = start + tail
            elif start is not None:
                memo[p] = start
        memo.update(zip(others, self._whole([" " + p for p in others]), strict=True))
        new = list({p[len(core):] for p, core in joined if p[len(core):] not in tails})
        tails.update(zip(new, self._whole(new), strict=True))
        for p, core in joined:
            start = memo.get(core)
            memo[p] = (old[core] if start is None else start) + tails[p[len(core):]]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; a null text has none.  What the memo lacks is asked for once for STRIDE texts."""
        out: list[bytes] = []
        for a in range(0, len(texts), STRIDE):
            out += self._stride([t or "" for t in texts[a : a + STRIDE]])
        return out

    def _stride(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        if len(self.tails) > MEMO:
            self.tails = {}
        get = self.memo.get
        if self.lower:  # this vocabulary drops white space: a single line end is a space
            texts = [self._flat(t) if "\n" in t else t for t in texts]
        whole = [i for i, t in enumerate(texts) if (_SPACE_THEN.search(t) and _INNER_SPACE.search(t)) or any(s in t for s in self.special)]
        done = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        heads, found, gaps, missing = [], [], [], set()
        for i, text in enumerate(texts):
            head, *pieces = ("" if i in done else text.lower() if self.lower and text.isascii() else text).split(" ")
            ids = [*map(get, pieces)]
            if None in ids:
                own = [k for k, x in enumerate(ids) if x is None]
                gaps.append((ids, own, [pieces[k] for k in own]))
                missing.update(gaps[-1][2])
            heads.append(head)
            found.append(ids)
        if missing:
            self._learn(missing)
            for ids, own, lost in gaps:
                for k, x in zip(own, map(get, lost), strict=True):
                    ids[k] = x
        first = self._whole(heads)
        return [done[i] if i in done else b"".join([first[i], *found[i]]) for i in range(len(texts))]


class SpacedEncoder(Encoder):
    """The same for a byte-level vocabulary that keeps case and white space."""

    def __init__(self, path: str):
        super().__init__(path, lower=False)
        self.known = pa.array([""], pa.large_string())  # the parts in the memo
        self.start, self.count, self.used = (np.zeros(1, np.int64) for _ in range(3))  # where their ids are in the pool; last call that met them
        self.pool = np.zeros(0, "<u4")
        self.calls = 0

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; a null text has none.  Pieces are looked up for about CHUNK characters at once."""
        out: list[bytes] = []
        a = size = 0
        for b, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= CHUNK or b == len(texts):
                out += self._chunk([t or "" for t in texts[a:b]])
                a, size = b, 0
        return out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        heads, rest, at = [], [], []
        for i, t in enumerate(texts):
            if (_SPACE_THEN.search(t) and _INNER_SPACE.search(t)) or any(s in t for s in self.special):
                heads.append(t)
                continue
            head, cut, tail = t.partition(" ")
            heads.append(head)
            if cut:
                rest.append(tail)
                at.append(i)
        out = self._whole(heads)
        if rest:
            split = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            pieces = self._pieces(coded.dictionary)
            ids, ends = ragged(*pieces, coded.indices.to_numpy())
            bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
            for i, s, e in zip(at, bounds[:-1], bounds[1:], strict=True):
                out[i] += ids[s:e].tobytes()
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every piece after its space: a pool, starts and counts."""
        parts, valid = _parts(pieces)
        n, m = len(pieces), len(parts[0])
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pa.concat_arrays([parts[0], pieces.filter(pa.array(~valid))]),
                                             pa.scalar("", pa.large_string()))
        coded = pa.concat_arrays([spaced, *parts[1:]]).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        of = np.zeros((n, 4), np.int64)  # place 0 has no ids
        of[valid, 0], of[~valid, 0] = place[:m], place[m:n]
        for k in range(3):
            of[valid, k + 1] = place[n + k * m : n + (k + 1) * m]
        ids, ends = ragged(self.pool, self.start, self.count, of.reshape(-1))
        ends = ends[3::4]
        return ids, np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Numbers of distinct parts in the memo; it learns what it lacks."""
        self.calls += 1
        found = pc.index_in(parts, value_set=self.known)
        new = parts.filter(found.is_null())
        if len(self.known) + len(new) > KNOWN:  # half of it goes, but the parts asked for now
            self.used[found.drop_null().to_numpy()] = self.calls
            late = np.argsort(-self.used[1:], kind="stable") + 1
            stay = np.sort(late[: max(KNOWN // 2, int((self.used[1:] == self.calls).sum()))])
            stay = np.concatenate([[0], stay])
            self.pool, ends = ragged(self.pool, self.start, self.count, stay)
            self.known, self.count, self.used = self.known.take(pa.array(stay)), self.count[stay], self.used[stay]
            self.start = ends - self.count
            found = pc.index_in(parts, value_set=self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            ids, start, count = self._new(new.to_pylist())
            self.start = np.concatenate([self.start, len(self.pool) + start])
            self.count = np.concatenate([self.count, count])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.pool = np.concatenate([self.pool, ids])
            self.known = pa.concat_arrays([self.known, new])
        self.used[place] = self.calls
        return place

    def _new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts, with starts and counts."""
        ids, ends, others, tokenize = array("I"), [0], [], self.tokenizer.model.tokenize
        space = chr(_BYTE_LETTERS[0x20])
        for i, p in enumerate(parts):
            word = p[1:] if p[0] == " " else p
            if word.isalpha():  # letters, with the space before them, are one word to the vocabulary
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids.extend([t.id for t in tokenize(space + word if p[0] == " " else word)])
            else:
                others.append(i)
            ends.append(len(ids))
        start, count = np.array(ends[:-1], np.int64), np.diff(np.array(ends, np.int64))
        each = self._whole([parts[i] for i in others])
        count[others] = n = np.array([len(x) // 4 for x in each], np.int64)
        start[others] = len(ids) + np.cumsum(n) - n
        return np.frombuffer(ids.tobytes() + b"".join(each), "<u4"), start, count


def _parts(pieces: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Letters, marks before a single line end, letters and marks of the pieces that are made so, and which those are."""
    offsets, data = (np.frombuffer(b, t) if b is not None else np.zeros(0, t) for b, t in zip(pieces.buffers()[1:], (np.int64, np.uint8), strict=True))
    begin, end = offsets[: len(pieces)], offsets[1 : len(pieces) + 1]
    kind = _PART_KIND[data[: end[-1]]]
    marks = np.concatenate([[0], np.cumsum(kind == 2)])
    stops, breaks = (np.append(np.flatnonzero(x), len(kind)) for x in (kind != 1, kind == 3))
    first = np.minimum(stops[np.searchsorted(stops, begin)], end)
    line = breaks[np.searchsorted(breaks, begin)]
    mid = np.where(line < end, line + 1, first)
    second = np.minimum(stops[np.searchsorted(stops, mid)], end)
    valid = (first > begin) & (marks[end] - marks[second] == end - second) & ((mid == first) | (marks[mid] - marks[first] == mid - 1 - first))
    cut = [_slices(data, s[valid], e[valid]) for s, e in ((begin, first), (first, mid), (mid, second), (second, end))]
    letters = np.logical_and(pc.utf8_is_alpha(cut[0]).to_numpy(zero_copy_only=False),
                             (second == mid)[valid] | pc.utf8_is_alpha(cut[2]).to_numpy(zero_copy_only=False))
    valid[np.flatnonzero(valid)[~letters]] = False
    return [c.filter(pa.array(letters)) for c in cut], valid


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings that stand between bytes of the data."""
    n = end - start
    offsets = np.concatenate([[0], np.cumsum(n)])
    taken = data[np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


@functools.lru_cache(maxsize=2)
def encoder(path: str, lower: bool = False) -> Encoder:
    """One encoder, with its memo, for a worker process."""
    return Encoder(path, lower) if lower else SpacedEncoder(path)
