"""Cross-tokenizer alignment against a plain reading of the contract."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, run string, radix int, part int"


@pytest.fixture(scope="module")
def paths():
    from marmot.llm.queries import tokenizer_path
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def _brute(docs, paths):
    """Every document's row: whole texts encoded, links by comparing all byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letter = {chr(x): x for x in plain}
    letter.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)})
    made, count = [], Counter()
    for d, text in docs:
        links, groups, x, y = [], [], [], []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            x, y = e.ids, b.encode(text)
            bx = [bytes(letter[c] for c in t) for t in e.tokens]
            by = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
            if b"".join(bx) == b"".join(by) == (" " + text).encode():
                spans = []
                for side in (bx, by):
                    ends = [0]
                    for t in side:
                        ends.append(ends[-1] + len(t))
                    spans.append(list(zip(ends, ends[1:])))
                j = 0
                for i, (s, t) in enumerate(spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(y) and spans[1][k][0] < t:
                        links.append((y[k], x[i]))
                        k += 1
                i = j = 0
                for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                    own = [[], []]
                    while i < len(x) and spans[0][i][1] <= end:
                        own[0].append(str(x[i]))
                        i += 1
                    while j < len(y) and spans[1][j][1] <= end:
                        own[1].append(str(y[j]))
                        j += 1
                    groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
            else:
                x, y = [], []
        count.update(links)
        made.append((d, len(x), len(y), groups, links))
    top = defaultdict(int)
    for (y, _), n in count.items():
        top[y] = max(top[y], n)
    return sorted(((d, n_a, n_b, len(g), len(li), sum(count[p] == top[p[0]] for p in li), sum(count[p] for p in li),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, g, li in made), key=str)


def _rows(frame):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_odd_texts(spark, paths, tmp_dir):
    from marmot.llm.alignment import alignment
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t", " ", "　", "a", "the", "don't", "ﬁ", "é", "é", "☃", "\U0001f600", "\x00", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>",
             "<0x41>", "word", "123", ".", "...", "!?", "\x1c", "​", "über", "漢字", "\r\n", "\x85"]
    docs = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    docs += [(500 + i, " ".join(rng.choice(marks[6:]) for _ in range(rng.randint(1, 25)))) for i in range(200)]
    docs += [(1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (3, "long text, " * 20_000), (4, " "), (5, "x" * 3_000)]
    frame = spark.createDataFrame([(d, t, "r", 1, 2) for d, t in docs], SCHEMA).repartition(7)
    assert _rows(alignment(frame, f"{tmp_dir}/a", *paths)) == _brute(docs, paths)
    assert alignment(frame.where("false"), f"{tmp_dir}/b", *paths).count() == 0


def test_many_small_runs_and_a_small_memo(spark, paths, tmp_dir, monkeypatch):
    from marmot.llm import alignment as L
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = [t for _, t in rows if t]
    monkeypatch.setattr(L, "MEMO", 50)
    both = L.Aligner(*paths)
    run, want = L._Run(), _brute(rows[:40], paths)
    stats = []
    for k in range(0, 40, 10):
        got, digest, pairs, doc = both.align([t for _, t in rows[k : k + 10]])
        stats += [(*map(int, s), h) for s, h in zip(got, digest)]
        assert len(pairs) == got[:, 3].sum()
    assert sorted((d, *s) for (d, _), s in zip(rows[:40], stats)) == sorted((*w[:5], w[7]) for w in want)
    assert pieces and not run.n_docs


def test_merge_counts_in_parts(tmp_dir, monkeypatch):
    """Runs merged in frames of three entries and sent back in parts of four."""
    import numpy as np
    import pyarrow as pa
    from marmot.llm import alignment as L
    monkeypatch.setattr(L, "HEAD_ENTRIES", 3)
    monkeypatch.setattr(L, "SEND", 4)
    rng = np.random.default_rng(0)
    want, manifest, links = Counter(), [], {}
    for r in range(5):
        run = L._Run()
        b, a, doc = rng.integers(0, 9, 300), rng.integers(0, 6, 300), rng.integers(0, 20, 300)
        run.add(pa.array(range(100 * r, 100 * r + 20)), np.zeros((20, 4), dtype=np.int64), [""] * 20, b * L._IDS + a, doc)
        for y, x, d in zip(b.tolist(), a.tolist(), doc.tolist()):
            want[y, x] += 1
            links.setdefault(100 * r + d, []).append((y, x))
        manifest += run.write(tmp_dir, 2)
    counted = []
    for radix in (0, 1):
        own = sorted(m for m in manifest if m[2] == radix)
        counted += [x for b in L._merge(radix, [(m[0], m[1], m[3], m[6]) for m in own]) for x in b.to_pylist()]
    assert max(c["part"] for c in counted) > 0
    rows_of = [dict(zip(("run", "file", "radix", "head_at", "body_at", "body_size", "entries"), m), part=-1, counts=None, best=None) for m in manifest]
    sent = [dict(c, head_at=0, body_at=0, body_size=0, entries=0) for c in counted]
    got = [x for b in L._adder(iter([pa.RecordBatch.from_pylist(sorted(rows_of + sent, key=lambda x: (x["run"], x["radix"], x["part"])))])) for x in b.to_pylist()]
    top = {y: max(n for (q, _), n in want.items() if q == y) for y, _ in want}
    for x in got:
        own = links.get(x["doc_id"], [])
        assert x["count_sum"] == sum(want[p] for p in own) and x["n_best"] == sum(want[p] == top[p[0]] for p in own)


def test_op12_on_the_table(spark, paths):
    from marmot.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(QUERIES["op12_token_alignment"](spark, SF)) == _brute(rows, paths)
