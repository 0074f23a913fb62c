"""Toxicity, personal data, HTML, quality, token files, packing and the pipeline."""
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0.5, 3) for d, t in rows], "doc_id bigint, text string, spans string, score double, length int")


EDGE = [(1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (3, "long " * 40_000), (4, "\x00 odd ퟿ ☃ \n\n")]


# ---------------------------------------------------------------- toxicity
def test_deobfuscation():
    from marmot.llm import toxicity as T
    text = "the idiot and the stupid moron or a loser with trash then and the other words of it " * 40
    buf = np.frombuffer(("  " + text).encode(), dtype=np.uint8)
    s = T._SYMBOL[buf]
    n = np.bincount((s[:-2] * T.SYMBOLS + s[1:-1]) * T.SYMBOLS + s[2:], minlength=T.SYMBOLS**3).reshape((T.SYMBOLS,) * 3).astype(float)
    model = np.log((n + 0.01) / (n.sum(axis=2, keepdims=True) + 1))
    r = T.Restorer(model)
    for seen, meant in (("1d10t", "idiot"), ("m0r0n!!", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("stuuupid", "stupid"),
                        ("tr@sh", "trash"), ("st*pid", "stupid"), ("l0$3r", "loser")):
        assert meant in r.words(f"the {seen} and"), seen
    assert r.words(None) == set() and r.words("") == set()
    assert T.suspicious("other") is None and T.suspicious("3.14") is None and T.suspicious("jo@example.com") is None


def test_toxicity_learns_and_scores(spark):
    from marmot.llm import toxicity as T
    from marmot.llm.quality import learnable
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(["sun", "moon", "river", "stone", "light", "walk"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = rng.choice(["grobian", "grobian", "schuft"])
        rows.append((i, " ".join(words) + f" {i}"))
        labels.append((i, 1, int(toxic)))
    docs, labelled = _docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, labelled)
    out = {r["doc_id"]: r["_predicted"] for r in T.scored(docs, model).where(~learnable()).collect()}
    assert out and all(p == int(d % 4 == 0) for d, p in out.items())
    hidden = T.scored(_docs(spark, [(1, "you gr0bian there"), (2, "walks by the river"), *EDGE]), model).collect()
    assert hidden[0]["_predicted"] == 1 and hidden[1]["_predicted"] == 0 and len(hidden) == 2 + len(EDGE)
    assert all(0 <= r["_score"] <= 1 for r in hidden) and hidden[0]["spans"] == "x"
    assert T.scored(_docs(spark, []), model).count() == 0


# ---------------------------------------------------------------- personal data
def _patterns(t):
    from marmot.llm.pii import luhn
    def digits(x):
        return re.sub("[^0-9]", "", x)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_patterns():
    from marmot.llm.pii import base_spans
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1234567890.@-+ ()%_") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["pay 4111 1111 1111 1111 now", "+49 30 1234567", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 255.1.1.1", "000000001.2.3.4"]
    assert all(base_spans(t) == _patterns(t) for t in texts)
    assert base_spans("9" * 200_000) == [] and base_spans("a" * 200_000 + "@") == []


def test_chain_is_exact():
    from marmot.llm.pii import chain
    rng = np.random.default_rng(3)
    for _ in range(60):
        spans = sorted({("email", int(s), int(s + rng.integers(1, 8))) for s in rng.integers(0, 20, 6)}, key=lambda x: (x[1], x[2]))
        score = rng.normal(0, 2, len(spans))
        ways = [[]]
        for j, (_, s, _) in enumerate(spans):
            ways += [w + [j] for w in ways if all(spans[i][2] <= s for i in w)]
        total = np.array([score[w].sum() for w in ways])
        chosen, p = chain(spans, score)
        assert chosen == ways[int(total.argmax())]
        weight = np.exp(total) / np.exp(total).sum()
        assert np.allclose(p, [sum(x for w, x in zip(ways, weight, strict=True) if j in w) for j in range(len(spans))])


def test_personal_data(spark):
    from marmot.llm.pii import find, fit
    rng = random.Random(5)
    made = [(i, f"mail to user{i}.x@mail{i}.example.com or call +49 30 {rng.randrange(10**6, 10**7)} host 10.0.{i % 200}.{i % 99} at home. The end {i}") for i in range(120)]
    field = fit(_docs(spark, made))
    got = find(_docs(spark, [(1, "ask jo.doe [at] example [dot] org today"), (2, "he is at home. The end"), *made[:5], *EDGE]), field).collect()
    assert got[0]["spans"].startswith("email:") and got[0]["n_email"] == 0 and got[1]["spans"] == ""
    assert all((r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1) for r in got[2:7]) and len(got) == 7 + len(EDGE)
    assert find(_docs(spark, []), field).count() == 0
    assert fit(_docs(spark, [])).extra("jo at example dot com", []) is not None


# ---------------------------------------------------------------- HTML
def test_html_blocks(spark):
    from marmot.llm.html import extract, main_text
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site name</header>
      <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and in the others.</div>
      <article><h1>A &amp; B</h1><p>First   paragraph
      of the text, long enough to be decided on its own, with some words of the language.<br>More.</p><p>Short.</p>
      <form><p>Subscribe</p></form><div id="comments"><p>Great post, thank you for it!</p></div></article>
      <aside>Related</aside><footer>&copy; 2024</footer></body></html>"""
    assert main_text(page) == "A & B\n\nFirst paragraph of the text, long enough to be decided on its own, with some words of the language. More.\n\nShort."
    plain = "<body><p>" + "This is the text of a page that has no article element but is long enough, with the words that it needs. " * 2 + "</p><p>So it ends.</p><p>Bye.</p><div><a href=x>one</a> <a href=y>two</a></div>"
    assert main_text(plain).endswith("needs.\n\nSo it ends.")  # the last short line is nearer to the links
    for broken in (None, "", "<", "<p", "<!-- never closed", "a < b", "<script>x", "<p>" * 5000):
        main_text(broken)
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x"), (2, "u", "", "x")]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in out] == [len(main_text(page))] * 2 + [0, 0]


# ---------------------------------------------------------------- quality
def test_sum_of_squares_identity():
    from marmot.llm.quality import FactorisationMachine
    fm = FactorisationMachine(50, 4)
    rng = np.random.default_rng(0)
    fm.w, fm.v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32)
    idx, val = np.array([3, 7, 20, 31]), np.array([1, 0.5, 2, 1], dtype=np.float32)
    z = fm.bias + sum(fm.w[i] * x for i, x in zip(idx, val, strict=True))
    z += sum(fm.v[idx[a]] @ fm.v[idx[b]] * val[a] * val[b] for a in range(4) for b in range(a + 1, 4))
    assert np.isclose(fm.score(idx, val, np.array([0, 4]))[0], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_quality_held_out_accuracy(spark):
    from marmot.llm.queries import op10_quality
    out = op10_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 15 and sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_quality_edge_rows(spark):
    from marmot.llm.quality import fit, scored
    model = fit(_docs(spark, []), spark.createDataFrame([], "doc_id bigint, quality int"))
    out = scored(_docs(spark, EDGE), model).collect()
    assert len(out) == len(EDGE) and all(0 <= r["_score"] <= 1 for r in out)
    assert scored(_docs(spark, []), model).count() == 0


# ---------------------------------------------------------------- tokens
@pytest.mark.parametrize("name,lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_memo_gives_the_librarys_ids(name, lower):
    from tokenizers import Tokenizer

    from marmot.llm.queries import tokenizer_path
    from marmot.llm.tokens import Encoder
    rng = random.Random(3)
    texts = ["", "  ", " a", "a  b", "x \n y", "x\t b", "don't we'll  it's  ", "é́ é x y   z", "<|endoftext|> a", "1234 56,78.\n\n\n a b\r\n c", "İstanbul ΑΣ ß ", "a\x1cb \x85 c"]
    texts += ["".join(rng.choice(" \n\t aA'1.é̀!sL ") for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    enc, lib = Encoder(tokenizer_path(name), lower), Tokenizer.from_file(tokenizer_path(name))
    for t, want in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want.ids, repr(t)


def test_memo_of_parts_gives_the_librarys_ids_and_stays_bounded(monkeypatch):
    from tokenizers import Tokenizer

    from marmot.llm import tokens as K
    from marmot.llm.queries import tokenizer_path
    monkeypatch.setattr(K, "KNOWN", 200)
    monkeypatch.setattr(K, "CHUNK", 400)
    rng = random.Random(4)
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [None, "", " ", " a", "a ", "a  b", "x \n y", "a b.\nCd, e\n f\n", "a b\n\nc d.\n\nE f", "we don't 's x'll, it's' 'm\n'd", "a é́b, é. ñ\u0301\nÉa x.é", "a <|endoftext|> b",
             "a ,b .c d1 2e f.\n1 g\n,h 東京。\n大阪 東京, а.\nб", "a \u00a0b \u00a0 c\u00a0 \x85d e\x1c f", "a İ, ß.\nß ª² x²,"]
    texts += ["".join(rng.choice(" \n\taAbc'1.,é̀!sL東 ") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    lib, asked = Tokenizer.from_file(path), K.SpacedEncoder(path)
    got = asked.encode_many(texts)
    for t, ids, want in zip(texts, got, lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(t)
    assert asked.calls > 100 and len(asked.known) < 600
    # a word is asked for once, whatever marks follow it
    enc = K.SpacedEncoder(path)
    new, seen = enc._new, []
    enc._new = lambda parts: seen.extend(parts) or new(parts)
    enc.encode_many(["x maggot", "x maggot, y", "x maggot.\nMaggot maggot!"])
    assert sorted(seen) == [" maggot", " y", "!", ",", ".\n", "Maggot"]


def test_toxic_scores_do_not_depend_on_the_memo(monkeypatch):
    from marmot.llm import toxicity as T
    rng = random.Random(5)
    words = ["maggot", "magg0t", "m a g g o t", "Maggot,", "digger", "letter", "lettter", "the", "éreelle", "mаggot", "stupid!!", "x", "Ab"]
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(60))]
    weights = {"maggot": 2.0, "magg+": 1.0, "stupid": 1.5, "digger": -0.5, "digg+": -0.25, "lett+": -1.0, "the": -0.1, "ereel+": 0.7}
    make = lambda: T.Model(_character_model("the maggot digger letter stupid ereele ab " * 30), weights, np.array([-1.0, 1, 1, 1, 0.5, 0.1]))
    whole = make()
    want = whole.scores(texts)
    r = T.Restorer(_character_model("the maggot digger letter stupid ereele ab " * 30))
    for t, got in zip(texts, whole.hits(texts), strict=True):  # every distinct restored word's best entry, once
        found = [[weights[f] for f in T.word_features({w}) if f in weights] for w in r.words(t)]
        assert sorted(got) == sorted(max(f) for f in found if f), t
    monkeypatch.setattr(T, "MEMO", 6)
    small = make()
    assert [s for t in texts for s in small.scores([t])] == want
    assert len(small.known) <= 6 + 13 and len(small.number) == len(small.weight)


def test_token_files_round_trip(spark, tmp_dir):
    from tokenizers import Tokenizer

    from marmot.llm import tokenfile as K
    from marmot.llm.queries import tokenizer_path
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [*EDGE, *((i, f"document {i} of the words " * (i % 7)) for i in range(10, 60))]
    manifest = K.write_token_files(_docs(spark, rows).repartition(3), f"{tmp_dir}/ids", path, lower=True, end=1)
    got = K.read_token_files(manifest).orderBy("start").collect()
    want = sorted(((d, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    crc = sorted((str(d), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == crc
    # a reader decompresses only the frames it needs, and notices damage
    file = max(manifest.collect(), key=lambda r: r["n_tokens"])["file"]
    r = K.Reader(file)
    some = int(r.ids[-1])
    assert r.find([some, 10**9]).keys() == {some} and r.frames_read <= 1 + r.size.sum() // (4 * K.FRAME_IDS)
    raw = bytearray(open(file.removeprefix("file:"), "rb").read())
    raw[9] ^= 0xFF
    with open(f"{tmp_dir}/bad.zst", "wb") as f:
        f.write(raw)
    with pytest.raises(Exception):  # noqa: B017 - the frame's own checksum or the table's
        K.Reader(f"{tmp_dir}/bad.zst").document(0)
    assert K.read_token_files(K.write_token_files(_docs(spark, []), f"{tmp_dir}/none", path, True, 1)).count() == 0


# ---------------------------------------------------------------- packing
def test_packing_evolves_until_nothing_gains(monkeypatch):
    import numpy as np
    from marmot.llm import packing as P
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(300, 1100, 200))
    start = P.start_population(sizes, P.CAPACITY, rng, P.POPULATION)
    children = []
    crossed = P.crossover
    monkeypatch.setattr(P, "crossover", lambda *a: children.append(1) or crossed(*a))
    out = P.evolve(start, sizes, P.CAPACITY, np.random.default_rng(6))
    least = -(-int(sizes.sum()) // P.CAPACITY)
    first, best = (max(P.fitness(p, sizes, P.CAPACITY) for p in x) for x in (start, out))
    assert best > first
    assert -best[0] == least or len(children) > P.PATIENCE
    for p in out:
        assert len(p) == len(sizes) and np.bincount(p, weights=sizes).max() <= P.CAPACITY
    # a population at the bound is left alone
    full = np.full(6, P.CAPACITY)
    children.clear()
    assert len(P.evolve([np.arange(6)], full, P.CAPACITY, rng)) == 1 and not children


def test_packing_is_complete_and_close_to_the_bound(spark):
    from marmot.llm.packing import pack, pieces
    from marmot.llm.queries import tokenizer_path
    rng = random.Random(6)
    rows = [*EDGE, *((i, "word " * rng.randrange(0, 3000)) for i in range(10, 200))]
    cut = pieces(_docs(spark, rows), tokenizer_path("byte_bpe_50k.json"), lower=False, end=0)
    out = pack(cut).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in out) == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in cut.collect())
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.05 * sum(r["length"] for r in out) / 2048 + 1
    assert all(r["length"] == 2048 for r in out if r["piece"] > 0)
    assert pack(cut.where("false")).count() == 0


def test_genetic_steps_keep_every_piece():
    from marmot.llm import packing as P
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 2048, 400))
    a, b = P.start_population(sizes, 2048, rng, 2)
    for child in (P.crossover(a, b, sizes, 2048, rng), P.mutate(a, sizes, 2048, rng), *P.evolve([a, b], sizes, 2048, rng)):
        fill = np.bincount(child, weights=sizes)
        assert child.min() == 0 and len(child) == 400 and fill.max() <= 2048 and fill.min() > 0
    assert P.fitness(P.evolve([a, b], sizes, 2048, rng)[0], sizes, 2048) >= max(P.fitness(x, sizes, 2048) for x in (a, b))


# ---------------------------------------------------------------- pipeline
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
        assert docs.select("doc_id").distinct().count() == sizes[-1]
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


# ---------------------------------------------------------------- toxicity: what reaches the decoder
def _character_model(text):
    from marmot.llm import toxicity as T
    s = T._SYMBOL[np.frombuffer(("  " + text).encode(), dtype=np.uint8)]
    n = np.bincount((s[:-2] * T.SYMBOLS + s[1:-1]) * T.SYMBOLS + s[2:], minlength=T.SYMBOLS**3).reshape((T.SYMBOLS,) * 3).astype(float)
    return np.log((n + 0.01) / (n.sum(axis=2, keepdims=True) + 1))


def test_every_obfuscated_token_is_decoded():
    from marmot.llm import toxicity as T
    r = T.Restorer(_character_model("you are a stupid maggot and the digger of holes, all assholes and shirts or an ass in class 12 with 345 hats of 2024, 10 a day! " * 40))
    for seen, meant in (("m4990t", "maggot"), ("d1663r", "digger"), ("5h1r75", "shirts"), ("a$$", "ass"), ("@$$h0l3", "asshole"), ("s  t  u  p  i  d", "stupid"),
                        ("s. t. u. p. i. d", "stupid"), ("s t u p i d", "stupid")):
        assert meant in r.words(f"the {seen} and"), (seen, r.words(seen))
        assert meant in r.words(f"x\n{seen}\ny"), seen
    sentence = " ".join("you are a stupid maggot and the digger of holes") .replace("     ", "  ").replace("   ", "  ")
    assert len(sentence) > 80 and {"stupid", "maggot", "digger"} <= r.words(sentence)
    assert {"stupid"} <= r.words(" ".join("stupid") + "  " + " ".join("holes" * 20_000))
    assert r.words("2024 345 12") <= {"2024", "345", "12"} and "dayi" not in r.words("a day!")


def test_precheck_accepts_what_the_spaced_pattern_accepts():
    from marmot.llm.toxicity import _SPACED, _SPACED_RUN
    rng = random.Random(3)
    for _ in range(20_000):
        text = f" {''.join(rng.choice('ab$ .-*  \n!x') for _ in range(rng.randint(3, 14)))} "
        if any(" " in m for m in _SPACED_RUN.findall(text)):
            assert _SPACED.search(text), text


def test_toxicity_with_noisy_labels_and_quoted_insults(spark):
    from marmot.llm import toxicity as T
    from marmot.llm.quality import learnable
    rng = random.Random(2)
    rows, labels, truth = [], [], {}
    for i in range(800):
        words = [rng.choice(["sun", "moon", "river", "stone", "light", "walk"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(20)]
        truth[i] = int(i % 4 == 0)
        if truth[i]:
            words[5:7] = rng.sample(["grobian", "schuft", "lump"], 2)
        elif i % 20 == 1:
            words[5] = rng.choice(["grobian", "schuft", "lump"])  # a clean text that quotes one
        rows.append((i, " ".join(words) + f" {i}"))
        labels.append((i, 1, truth[i] ^ (rng.random() < 0.04)))
    docs = _docs(spark, rows)
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    out = [(r["_predicted"], truth[r["doc_id"]]) for r in T.scored(docs, model).where(~learnable()).collect()]
    hit = sum(p and t for p, t in out)
    assert hit >= 0.9 * sum(t for _, t in out) and hit >= 0.9 * sum(p for p, _ in out) and hit > 10


# ---------------------------------------------------------------- HTML: open elements
def test_omitted_end_tags_do_not_hide_the_article():
    import time

    from marmot.llm.html import main_text
    said = "<article><p>This is the text of the article and it is long enough to be decided on its own, with the words that it needs.</p></article>"
    want = main_text(said)
    assert want.startswith("This is the text")
    for inside in ("<table>" + "<tr><td>x" * 300 + "</table>", "<dl>" + "<dt>x<dd>y" * 300 + "</dl>", "<table>" + "<tbody><tr><th>x<td><span>y" * 300 + "</table>",
                   "<ul>" + "<li><span>x" * 300 + "</ul>", "<div>" * 400, "<table><tr><td><table>" + "<tr><td>x" * 300 + "</table>y<td>z</table>"):
        assert main_text(f"<body><nav>{inside}</nav>{said}</body>") == want, inside[:40]
    for drawn in ("<svg/>", '<svg width="1" />', "<math/>", "<svg><path/></svg>"):
        assert main_text(f"<body>{drawn}{said}<p>x <svg></svg></p></body>") == want, drawn
    # a tag's end is found without a walk over the open elements
    began = time.perf_counter()
    main_text("<div>" * 30_000 + "</p><dt></dt>" * 30_000)
    assert time.perf_counter() - began < 20


SAID = "This is the text of the article and it is long enough to be decided on its own, with the words that it needs."


@pytest.mark.parametrize(("page", "want"), [
    (f'<div class="layout has-sidebar"><article><p>{SAID}</p></article><div class="sidebar">Links</div></div>', SAID),
    (f'<div class="content no-ads"><p>{SAID * 2}</p></div>', SAID * 2),
    (f'<div class="sidebar-left"><article><p>{SAID}</p></article></div>', SAID),
    (f'<article><header class="entry-header"><h1>The title</h1></header><p>{SAID}</p></article>', f"The title\n\n{SAID}"),
    (f'<article><h2 id="skip-lists">Skip lists</h2><p>{SAID}</p><h2 id="social-contract">The contract</h2><p>{SAID}</p></article>',
     f"Skip lists\n\n{SAID}\n\nThe contract\n\n{SAID}"),
    (f'<article><a name="top"><p>{SAID}</p><p>{SAID}</p></article>', f"{SAID}\n\n{SAID}"),
    (f'<article><p>{SAID}</p><video src=x><p>{SAID}</p></article>', f"{SAID}\n\n{SAID}"),
    (f'<article><p>{SAID}</p><ul><li><a href=/a>First source of it</a><li><a href=/b>Second source</a></ul></article>',
     f"{SAID}\n\nFirst source of it\n\nSecond source"),
    (f'<div class="ad">Buy this</div><article><p>{SAID}</p><div class="ad-slot">Buy that</div></article><div hidden><article><p>{SAID}</p></article></div>', SAID),
])
def test_pages_keep_their_article(page, want):
    from marmot.llm.html import main_text
    assert main_text(f"<html><body>{page}</body></html>") == want


# ---------------------------------------------------------------- personal data: candidates
def test_every_obfuscated_address_is_a_candidate():
    from marmot.llm.pii import candidates
    for text in ("jo{at}example{dot}org", "jo<at>example.org", "jo {AT} example.org", "jo\tat\texample dot org", "jo\nAT\nexample.org"):
        assert ("email", 0, len(text)) in candidates(text), text
