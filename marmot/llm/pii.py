"""Personal data in whole texts: pattern spans plus a semi-Markov conditional random field.

The base spans follow fixed patterns and always stay.  The field finds further ones
(obfuscated or oddly written): loose patterns propose candidate segments of bounded length,
every (segment, type) is scored by features of the whole span and its surroundings, and
dynamic programming over the candidates chooses boundaries and types together, everything
else being text.  Weights are fitted by maximum likelihood on windows of a bounded sample of
texts, whose labels are the base spans, each also rewritten in obfuscated forms; candidates
that no base span covers are the negative cases.  A chosen segment is added if its marginal
probability is high and it touches no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import prepare, rows

KINDS = ("email", "ip", "card", "phone")
LONGEST = 80
SURE = 0.95
#: most windows in a fit
FIT_WINDOWS = 4000
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a run that fails at its first digit fails at every one
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of every kind, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 60 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- candidate segments and their features
_AT = r"(?:@|\s?[\(\[\{<]\s?(?:at|AT|@)\s?[\)\]\}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\(\[\{<]\s?(?:dot|DOT|\.)\s?[\)\]\}>]\s?|\s(?:dot|DOT)\s)"
LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,40}}{_AT}[A-Za-z0-9-]{{1,30}}(?:{_DOT}[A-Za-z0-9-]{{1,20}}){{1,4}}"),
    "ip": re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\s?\(?[0-9](?:[\s()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
_OBFUSCATED = re.compile(r"[\(\[\{<]\s?(?:at|AT|@|dot|DOT|\.)\s?[\)\]\}>]|\s(?:dot|DOT)\s|\s(?:at|AT)\s")
# fixed values: words before a span that tell its kind
CUES = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write to|reach)\W{0,4}$", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server|from)\W{0,4}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|payment|amex|karte|carte|tarjeta)\W{0,4}(?:no\.?|number)?\W{0,4}$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|mobile|fax|fon|cell)\w{0,4}\W{0,4}$", re.I),
}
FEATURES = ("bias", "cue", "other_cue", "valid", "invalid", "bracketed", "spaced_at", "spaced_dot", "plain", "plus", "parens", "separators", "no_separator",
            "groups_even", "digits_short", "digits_mid", "digits_long", "tld", "long_tld", "capital_after_dot", "space_after_dot", "joined_left", "joined_right",
            "quoted", "decimal", "date")
_WHERE = {f: i for i, f in enumerate(FEATURES)}
WIDTH = len(FEATURES) * len(KINDS)


def candidates(text: str) -> list[Span]:
    """Proposed segments, at most LONGEST characters each, by start."""
    out = []
    for kind, pattern in LOOSE.items():
        if kind != "email" or "@" in text or "at" in text or "AT" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() <= LONGEST]
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def span_features(text: str, span: Span) -> list[int]:
    """Numbers of the features that hold for a segment of a type."""
    kind, s, e = span
    body, left, right = text[s:e], text[max(0, s - 24) : s], text[e : e + 2]
    on = ["bias"]
    for k, cue in CUES.items():
        if cue.search(left):
            on.append("cue" if k == kind else "other_cue")
    digits = _digits(body)
    if left[-1:].isalnum():
        on.append("joined_left")
    if right[:1].isalnum():
        on.append("joined_right")
    if left[-1:] in ("'", '"') or left[-1:] == "=":
        on.append("quoted")
    if kind in ("email", "ip"):
        if re.search(r"[\(\[\{<]", body):
            on.append("bracketed")
        if re.search(r"\s(?:at|AT)\s", body):
            on.append("spaced_at")
        if re.search(r"\s(?:dot|DOT)\s", body):
            on.append("spaced_dot")
        if not _OBFUSCATED.search(body):
            on.append("plain")
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", body)[-1]
        on.append("tld" if 2 <= len(last) <= 4 and last.isalpha() and last.islower() else "long_tld")
        if re.search(r"\.\s?[A-Z]", body):
            on.append("capital_after_dot")
        if re.search(r"\.\s", body):
            on.append("space_after_dot")
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", body)
        on.append("valid" if all(int(p) <= 255 for p in parts) else "invalid")
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", body)]
        on.append("digits_short" if len(digits) < 10 else "digits_mid" if len(digits) < 16 else "digits_long")
        on.append("separators" if len(groups) > 1 else "no_separator")
        if len(groups) > 2 and len(set(groups[:-1])) == 1:
            on.append("groups_even")
        if "+" in body[:1] or left[-1:] == "+":
            on.append("plus")
        if "(" in body:
            on.append("parens")
        if kind == "card":
            on.append("valid" if len(digits) >= 13 and luhn(digits) else "invalid")
        if re.fullmatch(r"[0-9]+[.,][0-9]+", body):
            on.append("decimal")
        if re.fullmatch(r"(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})", body):
            on.append("date")
    base = KINDS.index(kind) * len(FEATURES)
    return [base + _WHERE[f] for f in on]


# ---------------------------------------------------------------- the field
def chain(spans: list[Span], score: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The best choice of disjoint segments and every segment's marginal probability.

    Positions are the segments' ends and starts; between chosen segments lies text of score 0.
    Segments are at most LONGEST long, so a step looks back a bounded distance.
    """
    points = sorted({0} | {s for _, s, _ in spans} | {e for _, _, e in spans})
    place = {p: i for i, p in enumerate(points)}
    n = len(points)
    alpha, best, back = np.full(n, -np.inf), np.full(n, -np.inf), [(-1, -1)] * n
    alpha[0] = best[0] = 0.0
    into: list[list[int]] = [[] for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for j, (_, s, e) in enumerate(spans):
        into[place[e]].append(j)
        out[place[s]].append(j)
    for i in range(1, n):
        alpha[i], best[i], back[i] = alpha[i - 1], best[i - 1], (i - 1, -1)
        for j in into[i]:
            b = place[spans[j][1]]
            alpha[i] = np.logaddexp(alpha[i], alpha[b] + score[j])
            if best[b] + score[j] > best[i]:
                best[i], back[i] = best[b] + score[j], (b, j)
    beta = np.zeros(n)
    for i in range(n - 2, -1, -1):
        beta[i] = beta[i + 1]
        for j in out[i]:
            beta[i] = np.logaddexp(beta[i], beta[place[spans[j][2]]] + score[j])
    total = alpha[n - 1]
    p = np.array([np.exp(alpha[place[s]] + score[j] + beta[place[e]] - total) for j, (_, s, e) in enumerate(spans)])
    chosen, i = [], n - 1
    while i > 0:
        i, j = back[i]
        if j >= 0:
            chosen.append(j)
    return chosen[::-1], p


def _score(text: str, spans: list[Span], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[span_features(text, s)].sum() for s in spans])


class Field:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def extra(self, text: str, fixed: list[Span]) -> list[Span]:
        """Segments to add to the fixed spans."""
        free = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in fixed)]
        out = []
        for group in _clusters(free):
            chosen, p = chain(group, _score(text, group, self.weights))
            out += [group[j] for j in chosen if p[j] >= SURE]
        return out


def _clusters(spans: list[Span]) -> list[list[Span]]:
    """Groups of overlapping segments; disjoint groups are independent of each other."""
    out: list[list[Span]] = []
    end = -1
    for s in spans:
        if s[1] >= end or not out:
            out.append([])
        out[-1].append(s)
        end = max(end, s[2])
    return out


def _rewritten(body: str, kind: str, rng: np.random.Generator) -> str:
    """A span in another spelling."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        return body.replace("@", pick(" at ", " [at] ", "(at)", " (at) ", "[at]")).replace(".", pick(" dot ", "[dot]", " (dot) ", "(dot)", "."))
    if kind == "ip":
        return body.replace(".", pick("[.]", " dot ", "(.)", "[dot]"))
    if kind == "card":
        d = _digits(body)
        return pick(".", "/", "_", " - ").join(d[i : i + 4] for i in range(0, len(d), 4))
    d = _digits(body)
    return pick(f"({d[:3]}) {d[3:6]}-{d[6:]}", f"00{d}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"00 {d[:2]} {d[2:5]} {d[5:]}")


def fit_field(windows: list[tuple[str, list[Span]]], epochs: int = 6, seed: int = 3) -> Field:
    """Maximum likelihood by stochastic gradient over windows and their rewritten copies."""
    rng = np.random.default_rng(seed)
    data = []
    for text, gold in windows:
        data.append((text, gold))
        for k, s, e in gold[:1]:
            other = _rewritten(text[s:e], k, rng)
            shift = len(other) - (e - s)
            rest = [(a, b + shift, c + shift) for a, b, c in gold if b >= e]
            data.append((text[:s] + other + text[e:], [(k, s, s + len(other)), *rest]))
    weights, grad2 = np.zeros(WIDTH), np.full(WIDTH, 1e-4)
    weights[[i * len(FEATURES) for i in range(len(KINDS))]] = -1.0
    prior = weights.copy()
    groups = []
    for text, gold in data:
        for group in _clusters(candidates(text)):
            truth = {j for j, c in enumerate(group) if c in gold}
            # a gold span that is proposed with other bounds says nothing certain: leave its group out
            if not truth and any(c[1] < e and s < c[2] for c in group for _, s, e in gold):
                continue
            groups.append((group, [span_features(text, c) for c in group], truth))
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            group, feats, truth = groups[g]
            _, p = chain(group, np.array([weights[f].sum() for f in feats]))
            grad = np.zeros(WIDTH)
            for j, f in enumerate(feats):
                np.add.at(grad, f, (j in truth) - p[j])
            grad -= 1e-4 * (weights - prior)
            grad2 += grad * grad
            weights += 0.3 * grad / np.sqrt(grad2)
    return Field(weights)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts around candidates, with their base spans."""
    for batch in rows(batches):
        text, kinds, starts, ends = [], [], [], []
        for t in batch.column(0).to_pylist():
            base = base_spans(t or "")
            for group in _clusters(sorted({*candidates(t or ""), *base}, key=lambda s: (s[1], s[2], s[0]))):
                a, b = max(0, group[0][1] - 40), max(x[2] for x in group) + 20
                gold = [s for s in base if a <= s[1] and s[2] <= b and s[2] - s[1] <= LONGEST]
                text.append(t[a:b])
                kinds.append([k for k, _, _ in gold])
                starts.append([s - a for _, s, _ in gold])
                ends.append([e - a for _, _, e in gold])
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())),
                                          pa.array(ends, pa.list_(pa.int64()))], names=["window", "kinds", "starts", "ends"])


def fit(docs: DataFrame, most: int = FIT_WINDOWS) -> Field:
    """The field from at most ``most`` windows (of the smallest hashes), a bounded share for the driver."""
    prepare(docs.sparkSession)
    found = (docs.select(F.col("text").cast("string")).mapInArrow(_windows, "window string, kinds array<string>, starts array<bigint>, ends array<bigint>")
             .where(F.length("window") < 400))
    # labelled and unlabelled windows in equal bounds
    half = [found.where(c).orderBy(F.xxhash64("window"), "window").limit(most // 2).collect() for c in (F.size("kinds") > 0, F.size("kinds") == 0)]
    return fit_field([(r["window"], list(zip(r["kinds"], r["starts"], r["ends"], strict=True))) for h in half for r in h])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


OUTPUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _finder(field_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = field_var.value
        for batch in rows(batches):
            counts, digest, spans = [], [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + field.extra(t or "", base)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))),
                                              pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans: one row per input row.

    Positions are code points of the text, ends exclusive; a null text is empty; ids are
    carried as they are, null and repeated ones too; other columns are ignored; an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
            .mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(field)), OUTPUT))
