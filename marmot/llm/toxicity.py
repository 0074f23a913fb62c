"""Toxicity scores of whole texts behind a noisy-channel deobfuscator.

*Restoring.*  A token with look-alike characters inside letters, a run of spaced single
letters or a repeated letter opens a lattice: every character may stand for one of a few
letters, a repeated letter for one or two, a separator between single letters for nothing
or for a word break.  Viterbi decoding finds the path of the highest probability under a
character trigram model counted over **all documents** plus the channel's costs.  A token
of few letters, or with its last marks read as letters, counts as restored only if that
reading is likelier than the token as written.

*Scoring.*  Words and word beginnings of restored texts are counted by label over the
learnable labelled rows, near-copies counting once.  Every entry has as weight the smoothed
log odds of its toxic share against the base rate, every word that of its best entry.  A
logistic function of a text's strongest words and of the sum over all its words gives the
score; it is fitted on the same rows, each weighed without its own counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import NOT_SPACE, hashed_words, prepare, ragged, rows, saved, shingles
from marmot.llm.quality import fit_sample

# fixed values: letters that look-alike characters stand for
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il",
             "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "§": "s", "µ": "u", "×": "x", "ø": "o", "а": "a", "е": "e", "о": "o",
             "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ɑ": "a", "ı": "i"}
WILD = "*#%"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CUT = 0.7
#: most labelled rows in a fit (those of the smallest hash of doc_id)
FIT_ROWS = 20_000
MIN_TOXIC = 5
BEGINNINGS = (4, 5, 6, 7, 8)
#: tokens in a worker's memo; when it is full the half met last stays
MEMO = 400_000
#: texts at the base rate that every entry's count starts from
PRIOR = 5.0

# ---------------------------------------------------------------- character model
#: symbols: 0 boundary, 1-26 letters, 27 every other letter
SYMBOLS = 28
_SYMBOL = np.array([0] * 256, dtype=np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in rows(batches):
        buf = np.frombuffer(b"  " + b"  ".join((t or b"").lower() for t in batch.column(0).cast(pa.binary()).to_pylist()) + b" ", dtype=np.uint8)
        for a in range(0, len(buf), 1 << 20):
            s = _SYMBOL[buf[max(0, a - 2) : a + (1 << 20)]]
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from every text (at most 28**3 counts reach the driver)."""
    prepare(docs.sparkSession)
    counted = (docs.select(F.col("text").cast("string")).mapInArrow(_count_trigrams, "gram int, n bigint")
               .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(SYMBOLS**3)
    for r in counted:
        n[r["gram"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None, :, :]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three)


# ---------------------------------------------------------------- lattice and decoding
_REPEAT = re.compile(r"(.)\1+")
_EDGE = ".,;:?\"'()[]{}<>-_~`#%&*=/\\"
COST_SWAP, COST_WILD, COST_REPEAT, COST_BREAK = -0.7, -3.0, -0.3, -1.0
_SEPARATOR = re.compile(r"[ .\-_*~]+")
#: a number with a point or commas
_NUMBER = re.compile(r"[0-9]+(?:(?:,[0-9]{3})+(?:\.[0-9]+)?|\.[0-9]+)")


def _fold(c: str) -> str:
    """An accented letter's base letter, if it has one."""
    d = unicodedata.normalize("NFD", c)
    return d[0] if d and d[0] in _LETTERS else c


def suspicious(token: str) -> str | None:
    """What to decode of a token, or None if the token is as it seems."""
    core = token.strip(_EDGE).rstrip("!|+$@").lower()
    return core if _odd(core) else None


def _odd(core: str) -> bool:
    if len(core) < 3:
        return False
    if core.isalpha():
        return _REPEAT.search(core) is not None
    if _NUMBER.fullmatch(core) or core.startswith(("http", "www.")) or "@" in core and "." in core.rpartition("@")[2]:
        return False
    return _spaced(core) or any(c in LOOKALIKE or c in WILD or c in "._-" for c in core[1 if core[0] in WILD + "._-" else 0 :])


def _spaced(core: str) -> bool:
    return all(len(p) <= 1 for p in _SEPARATOR.split(core))


def _plain(core: str) -> bool:
    """Whether so many characters are letters that the restored reading counts beside the raw one in any case."""
    letters = sum(c.isalpha() for c in core)
    return letters >= 2 and letters * 5 >= 2 * sum(c not in " .-_~" for c in core)


def lattice(core: str) -> list[list[tuple[str, float]]]:
    """Per step the strings that may stand there and their cost."""
    if core.isascii() and core.isalpha():  # only repeated letters leave a choice: the stretches between them are one step each
        stretches, at = [], 0
        for m in _REPEAT.finditer(core):
            if m.start() > at:
                stretches.append([(core[at : m.start()], 0.0)])
            at, run = m.end(), m.end() - m.start()
            stretches.append([(m[1], COST_REPEAT * (run - 1)), (m[1] * 2, COST_REPEAT * (run - 2))])
        return [*stretches, [(core[at:], 0.0)]] if at < len(core) else stretches
    spaced = _spaced(core)
    narrow = min((len(m) for m in _SEPARATOR.findall(core)), default=0) if spaced else 0
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(core):
        c, j = core[i], i
        while j < len(core) and core[j] == c:
            j += 1
        if spaced and (m := _SEPARATOR.match(core, i)):
            # a wider gap than others is a word break by itself
            steps.append([(" ", 0.0), ("", COST_BREAK)] if len(m[0]) > narrow else [("", 0.0), (" ", COST_BREAK)])
            i = m.end()
            continue
        run, i = j - i, j
        if c in " .-_~":
            steps.append([(" ", 0.0), ("", COST_SWAP)])
            continue
        if c in WILD:
            steps += [[(x, COST_WILD) for x in _LETTERS] + ([("", COST_WILD)] if run > 1 else [])] * min(run, 3)
            continue
        options = [(x, COST_SWAP) for x in LOOKALIKE.get(c, "")] or [(_fold(c), 0.0)]
        if c.isalpha() and (_fold(c), 0.0) not in options:
            options.append((_fold(c), 0.0))
        if run > 1:
            options = [(x * k, cost + COST_REPEAT * (run - k)) for x, cost in options for k in (1, 2)]
        steps.append(options)
    return steps


_SYMBOLS = {" ": 0, **{c: i for i, c in enumerate(_LETTERS, 1)}}


def _symbol(c: str) -> int:
    return _SYMBOLS.get(c, 27)


def decode(core: str, model: list[float]) -> tuple[str, float]:
    """The likeliest reading of a lattice under the character model (states: the last two symbols), and its log probability."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(core):
        if len(options) == 1 and len(states) == 1:  # a stretch without a choice
            ((a, b), (p, said)), (string, cost) = *states.items(), options[0]
            p += cost
            for c in string:
                z = _SYMBOLS.get(c, 27)
                p += model[(a * SYMBOLS + b) * SYMBOLS + z]
                a, b = b, z
            states = {(a, b): (p, (said, string))}
            continue
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, said) in states.items():
            for string, cost in options:
                q, x, y = p + cost, a, b
                for c in string:
                    z = _SYMBOLS.get(c, 27)
                    q += model[(x * SYMBOLS + y) * SYMBOLS + z]
                    x, y = y, z
                old = after.get((x, y))
                if old is None or q > old[0]:
                    after[(x, y)] = (q, (said, string))
        states = after
    # the end of the word counts
    p, _, said = max((p + model[(a * SYMBOLS + b) * SYMBOLS], (a, b), said) for (a, b), (p, said) in states.items())
    parts = []
    while said:
        said, string = said
        parts.append(string)
    return "".join(reversed(parts)), p


def raw(core: str, model: list[float]) -> float:
    """Log probability of a token as it is written; what is no letter is a boundary."""
    p, x, y = 0.0, 0, 0
    for c in core + " ":
        z = _symbol(c) if c.isalpha() else 0
        p += model[(x * SYMBOLS + y) * SYMBOLS + z]
        x, y = y, z
    return p


#: how every match of _SPACED_RUN that holds white space or begins a longer token goes on after white space
_SPACED = re.compile(r"\s(?:[^\W_]|[@$!|+*])[ .\-_*~]{1,5}(?:[^\W_]|[@$!|+*])[ .\-_*~]")
_SPACED_RUN = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*])(?: {0,2}[ .\-_*~] {0,2}(?:[^\W_]|[@$!|+*])){2,}[.,;:?!]?(?!\S)")
_PARTS = re.compile(r"[^\w]+|_")


class Restorer:
    """Words of tokens, obfuscated ones also as restored."""

    def __init__(self, model: np.ndarray):
        self.model = model.reshape(-1).tolist()
        self.memo: dict[str, list[str]] = {}

    def token(self, token: str) -> list[str]:
        low = token.lower()
        bare = token.strip(_EDGE).lower()
        if bare.isalpha() and _REPEAT.search(bare) is None:  # a word as it seems, punctuation around it or not
            return [bare] if len(bare) > 1 or bare == low else []
        out = [low] if low.isalpha() else [p for p in _PARTS.split(low) if len(p) > 1]
        core = bare.rstrip("!|+$@")
        odd = _odd(core)
        for reading in dict.fromkeys((core, bare)):  # marks at the end may be letters
            if not (odd if reading is core else _odd(reading)):
                continue
            said, p = decode(reading, self.model)
            if reading == core and (core.isalpha() or _plain(core)) or p > raw(reading, self.model):
                out += said.split()
        if odd:
            joined = "".join(c for c in core if c not in " .-_~")
            if joined.isalpha():
                out.append(joined)
        return out

    @staticmethod
    def tokens(text: str) -> set[str]:
        found = set(text.split())
        padded = f" {text} "
        if _SPACED.search(padded):
            found.update(_SPACED_RUN.findall(padded))
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct lower-case words of the text, obfuscated ones also as restored."""
        memo, out = self.memo, set()
        if len(memo) > 200_000:
            memo.clear()
        for t in self.tokens(text or ""):
            got = memo.get(t)
            if got is None:
                got = memo[t] = self.token(t)
            out.update(got)
        return out


def word_features(words: set[str]) -> set[str]:
    out = {w for w in words if 3 <= len(w) <= 40}
    for w in [*out]:
        out.update(w[:k] + "+" for k in BEGINNINGS if len(w) > k)
    return out


def _feature_rows(model_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model_var.value)
        for batch in rows(batches):
            texts = batch.column(0).to_pylist()
            hashes, bounds = hashed_words([None if t is None else t.encode().lower() for t in texts], NOT_SPACE)
            kind = [int(shingles(hashes[bounds[i] : bounds[i + 1]], 5).min(initial=2**64 - 1)) >> 1 for i in range(len(texts))]
            feats = [sorted(word_features(restorer.words(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kind, pa.int64()), pa.array(feats, pa.list_(pa.string()))],
                                             names=["label", "kind", "feature"])
    return run


def weight(k: float, n: float, base: float) -> float:
    """Log odds of the toxic share of an entry in ``k`` toxic of ``n`` texts, against the base rate."""
    return math.log((k + PRIOR * base) / (n - k + PRIOR * (1 - base))) - math.log(base / (1 - base))


def summary(weights: list[float]) -> list[float]:
    """What the logistic function sees of a text's words."""
    top = sorted((w for w in weights if w > 0), reverse=True)[:3]
    return [1.0, *top, *[0.0] * (3 - len(top)), math.fsum(weights) / math.sqrt(max(1, len(weights))), math.log1p(len(weights))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of the largest penalised likelihood, by damped Newton steps."""
    def loss(c):
        z = x @ c
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (c[1:] @ c[1:])

    coefficients = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * coefficients)
        size = 1.0
        while size > 1e-6 and loss(coefficients + size * step) > loss(coefficients):
            size /= 2
        coefficients = coefficients + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return coefficients


def _left_out(counts_var, base: float):
    """(kind, label, x): what the logistic function sees of a labelled text, its own counts taken off."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_var.value
        starts = {f.rstrip("+")[:4] for f in counts}
        memo: dict[int, dict[str, float | None]] = {}  # by label: the weight of a word's best entry

        def best(w: str, label: int) -> float | None:
            found = [counts[f] for f in word_features({w}) if f in counts] if w[:4] in starts else []
            return max((weight(max(0, k - label), max(n - 1, k - label, 0), base) for k, n in found), default=None)

        for batch in rows(batches):
            labels, x = batch.column(0).to_pylist(), []
            for label, features in zip(labels, batch.column(2).to_pylist(), strict=True):
                own = memo.setdefault(label, {})
                if len(own) > 400_000:
                    own.clear()
                words = [w for w in features if w[-1] != "+"]
                for w in words:
                    if w not in own:
                        own[w] = best(w, label)
                x.append(summary([v for v in map(own.__getitem__, words) if v is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["kind", "label", "x"])
    return run


class Model:
    """Weights of restored words and their logistic function, with a bounded memo of what a token holds.

    The memo is asked for a batch's distinct tokens at once: an Arrow array of tokens over an array of word numbers.
    """

    def __init__(self, characters: np.ndarray, weights: dict[str, float], coefficients: np.ndarray):
        self.weights, self.coefficients = weights, coefficients.tolist()
        self.restorer = Restorer(characters)
        #: first letters of all entries: a word that begins otherwise has none
        self.starts = {f.rstrip("+")[:4] for f in weights}
        #: weights of beginnings by their letters
        self.begins = {f[:-1]: w for f, w in weights.items() if f[-1] == "+"}
        self.known = pa.array([], pa.large_string())
        self.start = self.count = self.used = np.zeros(0, np.int64)  # where a token's word numbers are in the pool; last call that met it
        self.pool = np.zeros(0, np.int64)
        self.number: dict[str, int] = {}  # of known words, in order
        self.weight = np.zeros(0)
        self.calls = 0

    def _forget(self) -> None:
        """Half the memo stays: the tokens met last, and their words."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: MEMO // 2])
        pool, ends = ragged(self.pool, self.start, self.count, stay)
        kept, self.pool = np.unique(pool, return_inverse=True)
        words = [*self.number]
        self.number = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.known, self.count, self.used, self.weight = self.known.take(pa.array(stay)), self.count[stay], self.used[stay], self.weight[kept]
        self.start = ends - self.count

    def best(self, word: str) -> float | None:
        """The weight of a word's best entry."""
        n = len(word)
        if not 3 <= n <= 40 or word[:4] not in self.starts:
            return None
        begins = self.begins
        found = [begins[word[:k]] for k in BEGINNINGS if n > k and word[:k] in begins]
        if word in self.weights:
            found.append(self.weights[word])
        return max(found, default=None)

    def _learn(self, tokens: pa.Array) -> None:
        """Put new tokens into the memo."""
        number, pool, ends, weights = self.number, [], [0], []
        for t in tokens.to_pylist():
            # what begins with four letters, none of them repeated, keeps them in any reading
            head = t[:4]
            plain = head not in self.starts and t.isascii() and t.isalpha() and _REPEAT.search(head) is None
            for w in () if plain else self.restorer.token(t):
                at = number.get(w)
                if at is None:
                    best = self.best(w)
                    if best is None:
                        continue
                    at = number[w] = len(number)
                    weights.append(best)
                pool.append(at)
            ends.append(len(pool))
        self.start = np.concatenate([self.start, len(self.pool) + np.array(ends[:-1], np.int64)])
        self.count = np.concatenate([self.count, np.diff(ends)])
        self.pool = np.concatenate([self.pool, np.array(pool, np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(tokens), np.int64)])
        self.weight = np.concatenate([self.weight, np.array(weights, np.float64)])
        self.known = pa.concat_arrays([self.known, tokens])

    def hits(self, texts: list[str | None]) -> list[list[float]]:
        """Of every text, the weights of its distinct known words' best entries."""
        tokens, ends = [], [0]
        for text in texts:
            tokens += self.restorer.tokens(text or "")
            ends.append(len(tokens))
        written = pa.array(tokens, pa.large_string()).dictionary_encode()
        # letters say the same with and without punctuation or capitals
        bare = pc.ascii_lower(pc.utf8_trim(written.dictionary, _EDGE))
        letters = pc.and_(pc.utf8_is_alpha(bare), pc.greater(pc.binary_length(bare), 1))
        coded = pc.if_else(letters, bare, written.dictionary).dictionary_encode()
        if len(self.known) + len(coded.dictionary) > MEMO:
            self._forget()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        place[new] = len(self.known) + np.arange(new.sum())
        self._learn(coded.dictionary.filter(found.is_null()))
        self.calls += 1
        self.used[place] = self.calls
        place = place[coded.indices.to_numpy()[written.indices.to_numpy()]]
        words, until = ragged(self.pool, self.start, self.count, place)
        bounds = np.concatenate([[0], until])[ends]
        # a word counts once a text
        pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(self.weight) + words)
        weights = self.weight[pairs % max(1, len(self.weight))].tolist()
        bounds = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(self.weight)).tolist()
        return [weights[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for found in self.hits(texts):
            z = sum(c * v for c, v in zip(self.coefficients, summary(found), strict=True))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Model:
    """The weights of a bounded sample of learnable labelled rows, counted by Spark; near-copies (one least shingle) count once."""
    spark = docs.sparkSession
    prepare(spark, 250)
    characters = character_model(docs)
    sample = fit_sample(labels, label, most)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("text", "label")
    found = saved(texts.mapInArrow(_feature_rows(spark.sparkContext.broadcast(characters)), "label int, kind bigint, feature array<string>"), "toxic-features")
    sums = found.agg(F.countDistinct(F.when(F.col("label") == 1, F.col("kind"))), F.countDistinct("kind")).first()
    base = (sums[0] + 0.5) / (sums[1] + 1)
    # what MIN_TOXIC toxic texts have; as the sample is bounded, so is this, and the others' features are not shuffled
    often = saved(found.where("label = 1").select("kind", F.explode("feature").alias("feature")).distinct()
                  .groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TOXIC).select("feature"), "toxic-words")
    each = (found.select("kind", "label", F.explode("feature").alias("feature")).join(F.broadcast(often), "feature")
            .groupBy("feature", "kind").agg(F.max("label").alias("label")))
    counted = each.groupBy("feature").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n"))
    counts = {r["feature"]: (r["k"], r["n"]) for r in counted.toLocalIterator()}
    seen = found.mapInArrow(_left_out(spark.sparkContext.broadcast(counts), base), "kind bigint, label int, x array<double>").collect()
    # copies are one text, toxic if one of them is
    texts = sorted({r["kind"]: (r["label"], r["x"]) for r in sorted(seen, key=lambda r: (r["kind"], r["label"], r["x"]))}.values())
    x = np.array([x for _, x in texts], dtype=np.float64).reshape(len(texts), len(summary([])))
    coefficients = logistic(x, np.array([y for y, _ in texts], dtype=np.float64))
    if not sums[0]:
        coefficients = np.array([math.log(base / (1 - base)), *[0.0] * (x.shape[1] - 1)])
    return Model(characters, {f: weight(k, n, base) for f, (k, n) in counts.items()}, coefficients)


def _scorer(model_var, text: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        for batch in rows(batches):
            p = model.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array([int(x >= cut) for x in p], pa.int32())],
                                             names=[*batch.schema.names, "_score", "_predicted"])
    return run


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` with _score (0 to 1, higher: toxic) and _predicted, one row per input row.

    A null text counts as empty; ids are never inputs, so null and repeated ids are rows
    like any other; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias("_score"), F.lit(0).alias("_predicted")).schema
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), cut), schema)
