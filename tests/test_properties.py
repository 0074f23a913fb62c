"""Randomized brute-force checks on tiny inputs (few examples: each one is a Spark job)."""
import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marmot.operators import metrics as M
from marmot.operators import prepare as P

FAST = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _metrics_py(rec, rel, k):
    """Definitions from the survey: precision over k, recall over the relevant list length
    (duplicates counted), DCG 1/log2(pos+1), ideal = first min(k, len) positions."""
    top = rec[:k]
    s = set(rel)
    hits = [1 if x in s else 0 for x in top]
    dcg = sum(h / math.log2(i + 2) for i, h in enumerate(hits))
    idcg = sum(1 / math.log2(i + 2) for i in range(min(k, len(rel))))
    return (sum(hits) / k, sum(hits) / len(rel) if rel else 0.0, dcg,
            dcg / idcg if idcg else 0.0, 1.0 if sum(hits) else 0.0)


@FAST
@given(st.lists(st.tuples(st.lists(st.integers(0, 12), min_size=1, max_size=8, unique=True),
                          st.lists(st.integers(0, 12), min_size=1, max_size=6)), min_size=1, max_size=4),
       st.sampled_from([1, 3, 5]))
def test_metrics_match_definitions(spark, users, k):
    recs = [(u, it, r + 1) for u, (rec, _) in enumerate(users) for r, it in enumerate(rec)]
    rel = [(u, it) for u, (_, lst) in enumerate(users) for it in lst]
    got = {r["user_idx"]: r for r in M.at_k(spark.createDataFrame(recs, "user_idx BIGINT, item_idx BIGINT, rank INT"),
                                            spark.createDataFrame(rel, "user_idx BIGINT, item_idx BIGINT"),
                                            ks=(k,)).collect()}
    for u, (rec, lst) in enumerate(users):
        want = _metrics_py(rec, lst, k)
        have = tuple(got[u][m] for m in ("precision", "recall", "dcg", "ndcg", "hit_rate"))
        assert all(abs(a - b) < 1e-9 for a, b in zip(have, want))


@FAST
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 1),
                          st.sampled_from([0.0, 1.0, 2.0, 5.0]), st.integers(0, 2), st.integers(1, 3)),
                min_size=1, max_size=25))
def test_dedup_matches_pandas(spark, rows):
    df = spark.createDataFrame([(u, i, lab, w, float(p), c) for u, i, lab, w, p, c in rows],
                               "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    got = sorted(tuple(r) for r in P.dedup_max_weight(df).collect())
    pdf = pd.DataFrame([(u, i, lab, w, float(p), c) for u, i, lab, w, p, c in rows],
                       columns=["user_idx", "item_idx", "label", "weight", "price_norm", "category_idx"])
    pdf = pdf.sort_values(["weight", "category_idx", "price_norm", "label"], ascending=[False, True, True, False])
    want = sorted(tuple(x) for x in pdf.drop_duplicates(["user_idx", "item_idx"], keep="first").itertuples(index=False))
    assert got == want
