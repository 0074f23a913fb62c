"""MinHash near-dedup, line dedup, decontamination and search against brute force, and their edge cases."""
import hashlib
import random
import re

import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))


def _docs(spark, rows, extra=True):
    """Rows (doc_id, text) with extra columns whose names clash with the operators' own."""
    if extra:
        return spark.createDataFrame([(d, t, "x", 1.0, 7) for d, t in rows], "doc_id bigint, text string, component_id string, score double, idx int")
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def _shingles(text, k):
    w = _words(text)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def _components(rows, k, percent):
    sets = {d: _shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_near_duplicates_against_brute_force(spark):
    from marmot.llm.minhash import near_duplicates
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(3, 160))]
        rows += [(len(rows) + j, " ".join(_edited(rng, base, rng.choice([0, 0, 1, 2, 4])))) for j in range(rng.randrange(1, 6))]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, LONG), (n + 6, LONG + " tail")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(_docs(spark, rows).repartition(5), k=4).collect()}
    assert got == _components(rows, 4, 80)


def test_near_duplicates_edge_rows(spark):
    from marmot.llm.minhash import near_duplicates
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, "x y z"), (7, "p q r"), (9, "p q r")]
    got = sorted((tuple(r) for r in near_duplicates(_docs(spark, rows), k=5).collect()), key=str)
    assert (5, 2, 3, False) in got and got.count((5, 2, 3, False)) == 2 and (3, 2, 3, True) in got
    assert (None, 2, None, True) in got                                        # no id: linked with nothing
    assert (9, 1, 7, False) in got and [r[0] for r in got].count(7) == 2       # one document, two texts
    assert near_duplicates(_docs(spark, []), k=5).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    from marmot.llm.components import components
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def _runs_deleted(docs, least):
    """All runs of all lengths, compared by content; later occurrences go."""
    seqs = [[(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" ")] if t is not None else [] for _, t in docs]
    first, gone = {}, [set() for _ in docs]
    for r in sorted(range(len(docs)), key=lambda r: (docs[r][0], r)):
        for i in range(len(seqs[r])):
            total = 0
            for j in range(i, len(seqs[r])):
                total += 1 + seqs[r][j][1].strip(" ").count(" ")
                if total >= least:
                    key = tuple(x for _, x in seqs[r][i : j + 1])
                    if first.setdefault(key, (r, i)) != (r, i):
                        gone[r].update(p for p, _ in seqs[r][i : j + 1])
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[r]) for r, (d, t) in enumerate(docs)}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_all_runs(spark, seed):
    from marmot.llm.linededup import line_deduplicated
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(8)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else f"u{rng.random()} x y" for _ in range(rng.randint(0, 14)))) for i in range(30)]
    docs[3], docs[5], docs[7] = (3, None), (5, docs[4][1]), (7, "")
    got = {r["doc_id"]: r["text"] for r in line_deduplicated(_docs(spark, docs).coalesce(1), 9).collect()}
    assert got == _runs_deleted(docs, 9)


def test_line_dedup_edge_rows(spark):
    from marmot.llm.linededup import deduplicated, line_deduplicated
    run = "\n".join(f"line {i} of a passage that repeats" for i in range(6))
    rows = [(1, "own start\n" + run), (2, run + "\nown end"), (2, run), (None, "mine\n" + run), (4, None), (5, "")]
    out = line_deduplicated(_docs(spark, rows).coalesce(1))
    assert out.columns[:5] == ["doc_id", "text", "component_id", "score", "idx"] and out.count() == 6
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.where("_n_deleted > 0").collect()) == [(1, "own start"), (2, ""), (2, "own end")]
    left = deduplicated(_docs(spark, rows).coalesce(1))
    assert left.count() == 5 and left.where("doc_id = 2").count() == 1          # the row of which nothing was left is gone
    assert line_deduplicated(_docs(spark, [])).count() == 0


def _contaminated(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for name, it in items:
            iw = words(it)
            k = min(10, len(iw))
            for i in range(len(iw) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == iw[i : i + k]:
                        hit.update(range(j, j + k))
                        names.add(str(name))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark, monkeypatch):
    from marmot.llm import decontaminate as D
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(6)] + ["été", "Ünder", "a1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(100, None), (101, ""), (102, "zz zz zz zz")]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(25)]
    docs += [(26, None), (27, "zz " * 9), (28, "Pre " + items[5][1].upper() + " post"), (28, items[6][1])]
    items += [(103, "zz " * 25 + "yy"), (104, "v0 v1 " * 12), (105, items[11][1])]
    docs += [(29, "zz " * 40), (30, "v1 v0 " * 20 + "yy"), (31, "zz " * 12 + "yy")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for words, candidates in ((D.BLOCK_WORDS, D.CANDIDATES), (30, 7)):  # one block, and many; candidates a few at a time
        monkeypatch.setattr(D, "BLOCK_WORDS", words)
        monkeypatch.setattr(D, "CANDIDATES", candidates)
        got = sorted((tuple(r) for r in D.summarise(D.contamination(_docs(spark, docs), bench)).collect()), key=str)
        assert got == _contaminated(docs, items)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.clean_documents(_docs(spark, docs), none).count() == len(docs)
    clean = D.clean_documents(_docs(spark, docs), bench)
    assert clean.columns == _docs(spark, docs).columns
    assert clean.count() == sum(not r[-1] for r in _contaminated(docs, items))
    assert D.clean_documents(_docs(spark, []), bench).count() == 0


def test_repetitive_items_and_texts_do_not_multiply():
    from marmot.llm import decontaminate as D
    from marmot.llm.common import ALNUM, hashed_words
    block = D.Block([("a", b"zz " * 20_000), ("b", b"zz " * 20_000), ("c", b"short item")])
    assert len(block.begin) == 2 and len(block.owners) == 3                  # one window of ten words, with two items
    block.choose_prefixes({})
    words, bounds = hashed_words([b"zz " * 200_000 + b"and a short item"], ALNUM)
    places = sum(len(s) for s, _ in block._occurrences(words))
    assert places == 200_000 - 9 + 1                                         # one candidate a place
    assert block.hits(words) == ([0, 200_002], [200_000, 200_004], [0, 1, 2])
    assert D.Block([]).owners.size == 0 and D.Block([("n", b"")]).owners.size == 0


def test_block_max_wand_is_exact(monkeypatch):
    from marmot.llm import search as S
    monkeypatch.setattr(S, "POSTINGS_IN_BLOCK", 4)
    rng = random.Random(2)
    for _ in range(1500):
        n, lists, score = rng.randint(1, 120), [], {}
        for _ in range(rng.randint(1, 8)):
            d = sorted(rng.sample(range(n), rng.randint(1, n)))
            im = [rng.randint(1, rng.choice([3, 50])) for _ in d]
            for x, y in zip(d, im, strict=True):
                score[x] = score.get(x, 0) + y
            cuts = range(0, len(d), 4)
            lists.append((d, im, [d[min(i + 4, len(d)) - 1] for i in cuts], [max(im[i : i + 4]) for i in cuts], max(im)))
        k = rng.randint(1, 8)
        assert S.block_max_wand(lists, k) == sorted(((s, d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_search_edge_rows(spark):
    from marmot.llm.search import top_k
    rows = [(1, "red green blue"), (2, "red green blue"), (3, "red"), (None, "red green"), (4, None), (5, ""), (6, "alone"), (6, "green green")]
    docs = _docs(spark, rows)
    got = top_k(docs, docs, k=2).collect()
    assert {(r["query_id"], r["rank"]): r["doc_id"] for r in got if r["query_id"] == 1} == {(1, 1): 1, (1, 2): 2}  # ties by id
    assert not [r for r in got if r["query_id"] in (4, 5, None) or r["doc_id"] is None]
    assert top_k(_docs(spark, []), _docs(spark, []), k=2).count() == 0


def _bm25(rows, queries, k):
    """The best k by BM25 of all distinct words of a query's text, by brute force."""
    import math
    from collections import Counter
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, Counter(words(t))) for d, t in rows]
    n, df = len(docs), Counter(w for _, c in docs for w in c)
    mean = sum(c.total() for _, c in docs) / n
    out = {}
    for q, t in queries:
        found = []
        for d, c in docs:
            s = sum(math.floor(1_000_000 * (math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2) / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))) + 0.5)
                    for w in set(words(t)) if w in c)
            found += [(-s, d)] if s else []
        out[q] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def test_search_scores_every_term_of_a_long_query(spark, monkeypatch):
    from marmot.llm import search as S
    rng = random.Random(9)
    vocab = [f"w{int(rng.paretovariate(0.5))}" for _ in range(600)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 40, 200])))) for i in range(120)]
    asked = [r for r in rows if r[0] % 4 == 0]
    want = _bm25(rows, asked, 5)
    monkeypatch.setattr(S, "BLOCK_ROWS", 700)
    got = {}
    for r in S.top_k(_docs(spark, rows).repartition(2), _docs(spark, asked), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == {q: w for q, w in want.items() if w}


def test_bounds_of_a_long_query_are_exact(monkeypatch):
    import numpy as np

    from marmot.llm import search as S
    rng = np.random.default_rng(4)
    asked = np.arange(40, dtype=np.uint64)
    for trials in ((0.1, 0.3), (0.6,), ()):
        monkeypatch.setattr(S, "TRIALS", trials)
        for n in (3, 4000):
            p = 1 / (1 + np.arange(40))
            terms = [np.flatnonzero(rng.random(40) < p).astype(np.uint64) for _ in range(n)]
            shard = S.Shard(list(range(n)), terms, [rng.integers(1, 4, len(t)) for t in terms], [50] * n, asked, np.linspace(0.1, 9, 40), 50.0)
            score = np.bincount(shard.doc, weights=shard.impact, minlength=n)
            want = sorted(((int(s), d) for d, s in enumerate(score) if s), key=lambda x: (-x[0], x[1]))[:5]
            assert shard.best(np.arange(40), 5) == want


def test_search_goes_in_rounds_with_floors(spark, monkeypatch):
    """Many shards return few rows for a query, the results are the exact best k; ties at the floor go to the smaller id."""
    from marmot.llm import search as S
    rng = random.Random(19)
    vocab = [f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(900)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 30, 90])))) for i in range(700)]
    rows += [(1000 + i, rows[8][1]) for i in range(60)] + [(8, "w1 w1 w3"), (8, rows[12][1])]
    asked = [r for r in rows if r[0] % 4 == 0 and r[0] != 8]
    want = _bm25(rows, asked, 5)
    for name, value in (("ONE_ROUND", 100), ("SHARD_DOCS", 16), ("POSTINGS_IN_BLOCK", 4), ("CELLS", 16 * 30)):
        monkeypatch.setattr(S, name, value)
    sent = []
    searcher = S._searcher
    monkeypatch.setattr(S, "_searcher", lambda *a: sent.append(a[1].value[0].max()) or searcher(*a))
    got = {}
    for r in S.top_k(_docs(spark, rows).repartition(6), _docs(spark, asked), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == {q: w for q, w in want.items() if w}
    assert len(sent) == 3 and sent[0] == 0 < sent[1] <= sent[2]


def test_a_group_just_below_the_threshold_makes_no_pair_rows(spark):
    """150 copies of a text, each with its own edits: most pairs lie below 0.8, some above; no link is lost."""
    import random

    from marmot.llm.minhash import near_duplicates
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        own = list(base)
        for j in rng.sample(range(120), 3):
            own[j] = f"x{k}-{j}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i:i + 4]) for i in range(117)} for t in texts]
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    below = above = 0
    for i in range(150):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                above += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            else:
                below += 1
    assert below > 10 * above
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, k=4, percent=80).collect()}
    assert got == {i: root(i) for i in range(150)}


def test_a_node_is_paired_with_few_hubs(spark):
    """Near copies that fall into many buckets: rows of pairs grow with the copies, whatever the number of buckets."""
    from marmot.llm import minhash as M
    rng = random.Random(3)
    members = [(b, r, r) for b in range(60) for r in range(1, 81) if rng.random() < 0.5]
    lean = spark.createDataFrame([(r, 100, [0] * 8) for r in range(1, 81)], "rep bigint, n bigint, sig array<bigint>")
    seen = []
    saved = M.saved

    def counted(df, name):
        out = saved(df, name)
        seen.append((name, out.count()))
        return out

    M.saved = counted
    try:
        best = M._hub_pairs(spark.createDataFrame(members, "bucket bigint, rep bigint, comp bigint"), lean, 80)
        one = M._hub_pairs(spark.createDataFrame([(b, r, r % 2) for b, r, _ in members], "bucket bigint, rep bigint, comp bigint"), lean, 80)
    finally:
        M.saved = saved
    rows = {r for p in best.collect() for r in p}
    assert rows == set(range(1, 81))                                         # every node has a pair
    assert max(n for name, n in seen if name == "minhash-star") <= M.NEAREST * 80
    assert all(r["a"] % 2 != r["b"] % 2 for r in one.collect())             # pairs are of different components
