"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2))``:
all pairwise interactions through rank-``RANK`` factors, in time linear in a text's features.
The inputs are the text and what is counted from it alone (its length is the metadata).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import ALNUM, NOT_SPACE, byte_class, hashed_words, mix64, prepare, rows, shingles

WORD_BITS, STATS, BINS, RANK = 16, 14, 16, 8
SIZE = (1 << WORD_BITS) + STATS * BINS
#: most labelled rows in a fit (those of the smallest hash of doc_id), a bound of the driver's share
FIT_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 1e-4

PUNCT = byte_class(lambda b: b < 0x80 and NOT_SPACE[b] and not ALNUM[b] and not 0x41 <= b <= 0x5A)
_KIND = np.array([0 if b == 0x20 else 1 if b == 0x0A else 2 if 0x61 <= b <= 0x7A else 3 if 0x41 <= b <= 0x5A else 4 if 0x30 <= b <= 0x39
                  else 5 if b in b".,;:'\"-()?" else 6 if b < 0x80 else 7 for b in range(256)], dtype=np.uint8)
_SHARES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of every text, one after another, and the texts' bounds."""
    low = [None if t is None else t.lower() for t in texts]
    words, bounds = hashed_words(low, ALNUM)
    marks, mark_bounds = hashed_words(low, PUNCT)
    idx, val, ends = [], [], [0]
    for i, text in enumerate(texts):
        raw = np.frombuffer(text or b"", dtype=np.uint8)
        n = max(1, len(raw))
        kinds = np.bincount(_KIND[raw], minlength=8) if len(raw) else np.zeros(8, dtype=np.int64)
        own = words[bounds[i] : bounds[i + 1]]
        distinct, times = np.unique(own, return_counts=True)
        m = max(1, len(own))
        threes = shingles(own, 3)
        letters = max(1, kinds[2] + kinds[3])
        mark = np.unique(marks[mark_bounds[i] : mark_bounds[i + 1]])
        shares = np.array([kinds[3] / letters, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[0] / n, kinds[1] / n,
                           len(distinct) / m, (times.max() if len(times) else 0) / m, 1 - len(np.unique(threes)) / max(1, len(threes)),
                           (mark_bounds[i + 1] - mark_bounds[i]) / m / 2])
        bins = np.searchsorted(_SHARES, np.minimum(shares, 1.0), "right") - 1
        more = [min(BINS - 1, int(2 * np.log10(n))), min(BINS - 1, int(2.5 * np.log10(m + (len(own) == 0) * 0.0))),
                min(BINS - 1, int(kinds[2:5].sum() + kinds[7]) // m)]
        stat = (1 << WORD_BITS) + np.arange(STATS) * BINS + np.concatenate([bins, more]).astype(np.int64)
        word = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        sign = (mix64(mark) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        idx += [stat, word, sign]
        val += [np.full(STATS, 0.5, np.float32), np.full(len(word), 1 / np.sqrt(max(1, len(word))), np.float32),
                np.full(len(sign), 0.5 / np.sqrt(max(1, len(sign))), np.float32)]
        ends.append(ends[-1] + STATS + len(word) + len(sign))
    return np.concatenate(idx).astype(np.int32), np.concatenate(val), np.array(ends, dtype=np.int64)


class FactorisationMachine:
    """Logistic factorisation machine fitted by AdaGrad on mini-batches."""

    def __init__(self, size: int, rank: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.w = np.zeros(size, dtype=np.float32)
        self.v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)

    def _parts(self, idx, val, starts):
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        square = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[idx] * val, starts)
        return vx, total, self.bias + linear + 0.5 * (total * total - square).sum(axis=1)

    def score(self, idx: np.ndarray, val: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.empty(len(bounds) - 1)
        for a in range(0, len(out), 256):  # every text has features, so no group is empty
            b = min(len(out), a + 256)
            s, e = bounds[a], bounds[b]
            z = self._parts(idx[s:e], val[s:e], bounds[a:b] - s)[2]
            out[a:b] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
        return out

    def fit(self, samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        gw, gv = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        self.bias = np.float32(np.log(share / (1 - share)))
        for _ in range(EPOCHS if len(labels) else 0):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), BATCH):
                rows_ = order[a : a + BATCH]
                idx = np.concatenate([samples[r][0] for r in rows_])
                val = np.concatenate([samples[r][1] for r in rows_])
                n = np.array([len(samples[r][0]) for r in rows_])
                vx, total, z = self._parts(idx, val, np.cumsum(n) - n)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows_]).astype(np.float32)
                each = np.repeat(err, n)
                uniq, place = np.unique(idx, return_inverse=True)
                dw = np.bincount(place, weights=each * val, minlength=len(uniq)).astype(np.float32) / len(rows_) + DECAY * self.w[uniq]
                grad = (each * val)[:, None] * (np.repeat(total, n, axis=0) - vx)
                dv = np.stack([np.bincount(place, weights=grad[:, f], minlength=len(uniq)) for f in range(grad.shape[1])], axis=1)
                dv = dv.astype(np.float32) / len(rows_) + DECAY * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                self.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= RATE * 0.3 * dv / np.sqrt(gv[uniq])
                self.bias -= np.float32(0.05 * err.mean())
        return self


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        idx, val, bounds = features(batch.column(0).cast(pa.binary()).to_pylist())
        offsets = pa.array(bounds.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(idx)), pa.ListArray.from_arrays(offsets, pa.array(val))],
                                         names=["label", "idx", "val"])


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` learnable rows, chosen by a hash of doc_id; unlabelled rows are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnable())
    return (usable.select("doc_id", F.col(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> FactorisationMachine:
    """The model from the texts of a bounded sample of learnable labelled rows (at most ``most``, so broadcast)."""
    prepare(docs.sparkSession)
    sample = F.broadcast(fit_sample(labels, label, most))
    texts = docs.select("doc_id", F.col("text").cast("string")).join(sample, "doc_id").select("text", "label")
    got = texts.mapInArrow(_featuriser, "label int, idx array<int>, val array<float>").toArrow()
    y = np.array(got["label"].to_pylist(), dtype=np.float32)
    x = [(np.array(i.values, dtype=np.int32), np.array(v.values, dtype=np.float32)) for i, v in zip(got["idx"], got["val"], strict=True)]
    order = sorted(range(len(y)), key=lambda r: (x[r][0].tobytes(), float(y[r])))  # the fit does not depend on the rows' order
    return FactorisationMachine(SIZE, RANK).fit([x[r] for r in order], y[order])


def _scorer(model_var, text: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        for batch in rows(batches):
            p = model.score(*features(batch.column(text).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))],
                                             names=[*batch.schema.names, "_score", "_predicted"])
    return run


def scored(docs: DataFrame, model: FactorisationMachine, cut: float = 0.5) -> DataFrame:
    """``docs`` with _score (0 to 1, higher: better text) and _predicted, one row per input row.

    A null text counts as empty; ids are never inputs, so null and repeated ids are rows
    like any other; an empty table gives an empty result.  Without any label every text
    scores the same.
    """
    prepare(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias("_score"), F.lit(0).alias("_predicted")).schema
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), cut), schema)
