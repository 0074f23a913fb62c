"""F9-F10: negative sampling invariants, blocked top-k vs brute force, content profiles."""
import numpy as np
from pyspark.sql import functions as F

from marmot.operators import candidates as CA
from marmot.operators import content as CB
from marmot.operators import sample as SA
from marmot.plans import etl as ETL

SF = "/root/testdata/sf0.001"


def test_f9_tiny(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "d")],
                               "user_idx BIGINT, item_idx STRING")
    neg = SA.negatives_per_user(df, n=1, seed=7).collect()
    by = {}
    for r in neg:
        by.setdefault(r["user_idx"], set()).add(r["item_idx"])
        assert r["label"] == 0 and r["weight"] == 0.0
    assert by[1] == {"c", "d"} and by[2] == {"d"}
    assert len(neg) == len({(r["user_idx"], r["item_idx"]) for r in neg})


def test_negatives_invariants_on_given_table(spark):
    train = ETL.split_part(spark, SF, "train").select("user_idx", "item_idx")
    pos = {(r[0], r[1]) for r in train.collect()}
    items = {i for _, i in pos}
    neg = SA.negatives_per_user(train, n=5, seed=42).select("user_idx", "item_idx").collect()
    pairs = [(r[0], r[1]) for r in neg]
    assert len(pairs) == len(set(pairs)) and not (set(pairs) & pos)
    for u in {u for u, _ in pos}:
        p = len({i for uu, i in pos if uu == u})
        assert sum(1 for uu, _ in pairs if uu == u) == min(5 * p, len(items) - p)
    again = SA.negatives_per_user(train, n=5, seed=42).select("user_idx", "item_idx").collect()
    assert sorted(pairs) == sorted((r[0], r[1]) for r in again)


def test_global_ratio(spark):
    train = ETL.split_part(spark, SF, "train")
    pos = {(r[0], r[1]) for r in train.select("user_idx", "item_idx").collect()}
    neg = SA.negatives_global_ratio(train, 0.2, seed=1).collect()
    assert len(neg) == int(train.count() * 0.2)
    assert all((r["user_idx"], r["item_idx"]) not in pos and r["label"] == 0 and r["weight"] == 1.0 for r in neg)


def test_blocked_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    Q, X = rng.normal(size=(37, 8)), rng.normal(size=(53, 8))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(37)], "user_idx BIGINT, embedding ARRAY<DOUBLE>")
    idf = spark.createDataFrame([(j, X[j].tolist()) for j in range(53)], "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    ex = spark.createDataFrame([(0, int(np.argmax(Q[0] @ X.T)))], "user_idx BIGINT, item_idx BIGINT")
    S = Q @ X.T
    S[0, int(np.argmax(S[0]))] = -np.inf
    for chunk in (16, 1000):  # several item chunks, and one
        got = CA.blocked_top_k(qdf, idf, 5, query_block=10, item_block=chunk, exclude_pairs=ex).collect()
        res = {}
        for r in got:
            res.setdefault(r["user_idx"], []).append((r["rank"], r["item_idx"]))
        for u in range(37):
            want = list(np.argsort(-S[u], kind="stable")[:5])
            assert [i for _, i in sorted(res[u])] == want


def test_top_k_ties_break_by_item_id(spark):
    qdf = spark.createDataFrame([(1, [1.0, 0.0])], "user_idx BIGINT, embedding ARRAY<DOUBLE>")
    idf = spark.createDataFrame([(j, [1.0, 0.0]) for j in (9, 3, 7, 5)] + [(2, [0.5, 0.0])],
                                "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    for chunk in (2, 100):
        got = sorted((r["rank"], r["item_idx"]) for r in CA.blocked_top_k(qdf, idf, 2, item_block=chunk).collect())
        assert got == [(1, 3), (2, 5)]


def test_f10_profiles_and_content(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, -1.0])],
                                 "item_idx BIGINT, embedding ARRAY<FLOAT>")
    hist = spark.createDataFrame([(9, 1, 1.0), (9, 1, 1.0), (9, 2, 1.0), (5, 77, 1.0)],
                                 "user_idx BIGINT, item_idx BIGINT, weight DOUBLE")
    prof = CB.profiles(hist, vecs).collect()
    assert [list(r["profile"]) for r in prof if r["user_idx"] == 9] == [[0.5, 0.5]]
    users = spark.createDataFrame([(9,), (5,), (6,)], "user_idx BIGINT")
    out = CB.similar_items(hist, vecs, users, n=5).collect()
    u9 = [r["item_idx"] for r in sorted((r for r in out if r["user_idx"] == 9), key=lambda r: r["rank"])]
    assert u9 == [3]                                   # 1, 2 touched; 4 has cosine < 0
    assert {r["reason"] for r in out if r["user_idx"] == 5} == {"fallback_popular"}
    assert {r["reason"] for r in out if r["user_idx"] == 6} == {"popular_item"}


def _permutation(n, key):
    """The permutation in plain integers: x -> place."""
    from marmot.functions import permutation as PM
    a, b = PM.sides(n)

    def mixed(v, i):
        return (v * (key[2 * i] + 1) + key[2 * i + 1]) % PM.PRIME // PM.DROPPED

    def step(x):
        hi, lo = divmod(x, b)
        for i in range(4):
            if i % 2 == 0:
                hi = (hi + mixed(lo, i)) % a
            else:
                lo = (lo + mixed(hi, i)) % b
        return hi * b + lo

    out = []
    for x in range(n):
        y = step(x)
        while y >= n:
            y = step(y)
        out.append(y)
    return out


def test_keyed_permutation_is_one_and_inverts(spark):
    import hashlib

    from marmot.functions import permutation as PM
    for n in (1, 2, 3, 7, 97, 100, 1009):
        rows = spark.range(n).select("id", F.explode(F.array(F.lit("u1"), F.lit("u2"))).alias("u"))
        key = PM.keys("u", seed=9)
        out = rows.select("u", "id", PM.permuted(F.col("id"), n, key).alias("y")).withColumn("back", PM.unpermuted(F.col("y"), n, key)).collect()
        assert all(r["back"] == r["id"] for r in out)
        for u in ("u1", "u2"):
            digest = hashlib.sha256(f"{u}|9".encode()).hexdigest()
            got = [r["y"] for r in sorted((r for r in out if r["u"] == u), key=lambda r: r["id"])]
            assert sorted(got) == list(range(n))
            assert got == _permutation(n, [int(digest[7 * i:7 * i + 7], 16) for i in range(8)])


def test_negatives_are_the_first_free_places(spark):
    """Brute force: walk the user's permutation and skip positives; heavy, full and null users included."""
    import hashlib
    import random
    rng = random.Random(4)
    items = [f"i{k:03d}" for k in range(83)]
    pos = {("heavy", i) for i in items[:70]} | {("full", i) for i in items} | {(f"u{k}", i) for k in range(20) for i in rng.sample(items, rng.randint(1, 12))}
    rows = [*pos, *list(pos)[:30], (None, "i001"), ("u1", None)]
    neg = SA.negatives_per_user(spark.createDataFrame(rows, "user_idx STRING, item_idx STRING"), n=4, seed=3)
    got = {}
    for r in neg.collect():
        got.setdefault(r["user_idx"], []).append(r["item_idx"])
    for u in {u for u, _ in pos}:
        own = {i for v, i in pos if v == u}
        digest = hashlib.sha256(f"{u}|3".encode()).hexdigest()
        places = [items[y] for y in _permutation(len(items), [int(digest[7 * i:7 * i + 7], 16) for i in range(8)])]
        want = [i for i in places if i not in own][: min(4 * len(own), len(items) - len(own))]
        assert sorted(got.get(u, [])) == sorted(want), u
    assert set(got) <= {u for u, _ in pos} and "full" not in got
    plan = neg._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(user_idx" not in plan
    assert SA.negatives_per_user(spark.createDataFrame([], "user_idx STRING, item_idx STRING")).count() == 0


def test_negatives_spread_evenly_over_items(spark):
    """20,000 users with one item each: every other item is drawn about equally often."""
    df = spark.range(20_000).select(F.col("id").alias("user_idx"), (F.col("id") % 50).alias("item_idx"))
    counts = [r["count"] for r in SA.negatives_per_user(df, n=5).groupBy("item_idx").count().collect()]
    assert len(counts) == 50 and sum(counts) == 100_000
    assert max(counts) < 2000 * 1.12 and min(counts) > 2000 * 0.88


def test_norm_bounds_prune_chunks_and_stay_exact(spark):
    """Items of very different norms: the answer equals brute force (ties, exclusions, a floor), and most (query, band) pairs are never scored."""
    rng = np.random.default_rng(1)
    n_q, n_i, k = 60, 400, 5
    Q = rng.normal(size=(n_q, 6))
    X = rng.normal(size=(n_i, 6)) * (50.0 / np.arange(1, n_i + 1))[:, None]
    X[300:320] = X[0]                                                     # ties with the largest item
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(n_q)], "user_idx BIGINT, embedding ARRAY<DOUBLE>")
    idf = spark.createDataFrame([(j, X[j].tolist()) for j in range(n_i)], "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    S = Q @ X.T
    out = [(q, int(j)) for q in range(0, n_q, 3) for j in np.argsort(-S[q], kind="stable")[:30]]
    ex = spark.createDataFrame(out, "user_idx BIGINT, item_idx BIGINT")
    for q, j in out:
        S[q, j] = -np.inf
    for floor in (None, 0.5):
        got = {}
        for r in CA.blocked_top_k(qdf, idf, k, item_block=20, min_score=floor, exclude_pairs=ex).collect():
            got.setdefault(r["user_idx"], {})[r["rank"]] = r["item_idx"]
        for q in range(n_q):
            order = sorted(range(n_i), key=lambda j: (-round(S[q, j], 9), j))
            want = [j for j in order if np.isfinite(S[q, j]) and (floor is None or S[q, j] > floor)][:k]
            assert [got.get(q, {})[r] for r in sorted(got.get(q, {}))] == want, q
    normed = idf.withColumn("nn", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))
    cuts, bands = CA.norm_bands(normed, "nn", 20)
    assert sum(b.rows for b in bands) == n_i and all(b.rows <= 60 for b in bands) and [b.max_norm for b in bands] == sorted((b.max_norm for b in bands), reverse=True)
    kth = spark.createDataFrame([(q, float(np.linalg.norm(Q[q])), float(np.sort(S[q])[-k])) for q in range(n_q)], "q INT, n DOUBLE, kth DOUBLE")
    asked = kth.select(F.size(CA.open_bands(F.col("n"), F.col("kth"), bands, 2)).alias("c")).agg(F.sum("c")).first()[0]
    assert asked < 0.5 * n_q * (len(bands) - 2)
    every = kth.select(F.size(CA.open_bands(F.col("n"), F.lit(None).cast("double"), bands, 2)).alias("c")).agg(F.sum("c")).first()[0]
    assert every == n_q * sum(b.rows > 0 for b in bands[2:])


def test_equal_norms_make_one_band_of_several_chunks(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(90, 4))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    Q = rng.normal(size=(9, 4))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(9)], "user_idx BIGINT, embedding ARRAY<DOUBLE>")
    idf = spark.createDataFrame([(j, X[j].tolist()) for j in range(90)], "item_idx BIGINT, embedding ARRAY<DOUBLE>")
    got = {}
    for r in CA.blocked_top_k(qdf, idf, 3, item_block=10).collect():
        got.setdefault(r["user_idx"], {})[r["rank"]] = r["item_idx"]
    for q in range(9):
        assert [got[q][r] for r in (1, 2, 3)] == list(np.argsort(-(X @ Q[q]), kind="stable")[:3])
    assert CA.blocked_top_k(qdf, idf.where("false"), 3).count() == 0


def test_profile_is_one_aggregate(spark):
    vecs = spark.createDataFrame([(j, [float(j), 1.0, -float(j)]) for j in range(50)], "item_idx BIGINT, embedding ARRAY<FLOAT>")
    hist = spark.createDataFrame([(u, j) for u in range(5) for j in range(50) if j % (u + 1) == 0], "user_idx BIGINT, item_idx BIGINT")
    prof = CB.profiles(hist, vecs)
    for r in prof.collect():
        m = np.mean([j for j in range(50) if j % (r["user_idx"] + 1) == 0])
        assert np.allclose(r["profile"], [m, 1.0, -m])
    assert "Generate" not in prof._jdf.queryExecution().executedPlan().toString()


def test_users_outside_the_model_get_weight_sums_of_their_category(spark):
    from marmot.operators import candidates as CA
    from marmot.plans import serve as SV
    t = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 5.0, 1), (2, 10, 1.0, 1), (2, 12, 2.0, 2), (2, 13, None, 2), (2, None, 9.0, 1),
                               (1, 14, 7.0, None), (3, 12, 4.0, 1)], "user_idx BIGINT, item_idx BIGINT, weight DOUBLE, category_idx INT")
    reqs = spark.createDataFrame([(1, 1, None, [10, 11, 12]), (2, 7, None, [10]), (3, 8, 2, [10]), (4, None, 1, []), (5, 9, 6, [10])],
                                 "request_id BIGINT, user_id BIGINT, category_id INT, available_items ARRAY<BIGINT>")
    vec = lambda name, ids: spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], f"{name} BIGINT, v ARRAY<DOUBLE>")
    got = CA.mf_candidates(SV.route(reqs, t), t, vec("user_id", [1]), vec("item_idx", [10, 11, 12]), k=3)
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r["request_id"], r["mf_rank"])):
        rows.setdefault(r["request_id"], []).append((r["item_idx"], r["mf_score"]))
    assert rows == {1: [(12, 13.0), (10, 11.0)],                    # the model's; 11 was bought
                    2: [(14, 7.0), (12, 6.0), (11, 5.0)],           # over all categories, the available items aside
                    3: [(12, 2.0), (13, 0.0)],                      # only rows of the category count
                    4: [(11, 5.0), (12, 4.0), (10, 2.0)]}           # a null user is unknown; category 6 has no rows
