"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Views ``events part customer orders lineitem embeddings ...`` are registered
by the checker.  Computed doubles are rounded to 6 places on both sides;
ranks are INTEGER, counts BIGINT.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- shared CTEs
ITEMS = """items AS (
  SELECT p_partkey AS item_id, CAST(p_retailprice AS DOUBLE) AS price, p_name AS title,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS category_idx
  FROM part)"""

EV = """ev AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         event_type AS action, ts
  FROM events)"""

INTER = """inter AS (
  SELECT ev.event_id, ev.user_id, ev.item_id, ev.action, ev.ts, items.price, items.title, items.category_idx,
         CAST(CASE ev.action WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 1 END AS DOUBLE) AS weight,
         CASE WHEN ev.action IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS label
  FROM ev JOIN items ON ev.item_id = items.item_id)"""

PSTATS = """pstats AS (
  SELECT AVG(price) AS mean, STDDEV_POP(price) AS std, VAR_POP(price) AS var FROM items)"""

ROWS = """trows AS (
  SELECT inter.user_id AS user_idx, inter.item_id AS item_idx, label, weight,
         (price - pstats.mean) / CASE WHEN pstats.std = 0 THEN 1 ELSE pstats.std END AS price_norm,
         category_idx, ts, event_id
  FROM inter, pstats)"""

SPLITS = """q AS (
  SELECT quantile_cont(epoch_us(ts), 0.7) AS q70, quantile_cont(epoch_us(ts), 0.85) AS q85 FROM trows),
tagged AS (
  SELECT trows.*, CASE WHEN epoch_us(ts) <= q.q70 THEN 'train' WHEN epoch_us(ts) <= q.q85 THEN 'val' ELSE 'test' END AS split
  FROM trows, q),
act AS (SELECT user_idx FROM tagged WHERE split = 'train' GROUP BY user_idx HAVING COUNT(*) >= 3),
splits AS (
  SELECT * FROM tagged WHERE split <> 'train' OR user_idx IN (SELECT user_idx FROM act))"""

# train split deduplicated to one row per (user, item): highest weight, ties by category, price_norm asc, label desc
TRAIN = """train AS (SELECT * FROM splits WHERE split = 'train'),
val AS (SELECT * FROM splits WHERE split = 'val'),
test AS (SELECT * FROM splits WHERE split = 'test')"""

LOGS = """logs AS (
  SELECT CAST(epoch_us(ev.ts) // 1000 AS BIGINT) AS timestamp, ev.item_id, CAST(ev.user_id AS VARCHAR) AS user_id, upper(ev.action) AS action,
         items.category_idx AS category_id, items.price, ev.event_id
  FROM ev JOIN items ON ev.item_id = items.item_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (ITEMS, EV, INTER)
TRAIN_BASE = (ITEMS, EV, INTER, PSTATS, ROWS, SPLITS, TRAIN)

SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


# --------------------------------------------------------------------------- popularity (flagship)
register("popularity_composite", with_(*TRAIN_BASE, """pop AS (
  SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS weight_sum, COUNT(DISTINCT user_idx) AS n_users FROM train GROUP BY item_idx),
meta AS (SELECT item_idx, MIN(category_idx) AS category_idx FROM train GROUP BY item_idx),
sc AS (
  SELECT pop.item_idx, meta.category_idx, pop.weight_sum, pop.n_users,
         0.7 * (pop.weight_sum / MAX(pop.weight_sum) OVER ()) + 0.3 * (pop.n_users / CAST(MAX(pop.n_users) OVER () AS DOUBLE)) AS s
  FROM pop JOIN meta USING (item_idx)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY category_idx ORDER BY s DESC, item_idx) AS INTEGER) AS rank FROM sc)""") + """
SELECT category_idx, rank, item_idx, weight_sum, n_users, ROUND(s, 6) AS popularity_score FROM rk WHERE rank <= 10""")


def dedup_cte(name: str, src: str) -> str:
    """Highest weight per (user_idx, item_idx); ties: category, price_norm ascending, label descending."""
    return f"""{name} AS (
  SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM (
    SELECT *, row_number() OVER (PARTITION BY user_idx, item_idx
                                 ORDER BY weight DESC, category_idx ASC, price_norm ASC, label DESC) AS _rn
    FROM {src}) WHERE _rn = 1)"""


D4_STRING = "CAST(user_idx AS VARCHAR) AS user_idx, item_idx, label, weight, ROUND(price_norm, 6) AS price_norm, category_idx"
D4_OUT = "user_idx, item_idx, label, weight, ROUND(price_norm, 6) AS price_norm, category_idx"

LOG_WEIGHT = ("CAST(CASE action WHEN 'VIEW' THEN 1 WHEN 'CLICK' THEN 2 WHEN 'ADD_CART' THEN 3 "
              "WHEN 'PURCHASE' THEN 5 ELSE 1 END AS DOUBLE)")

LOGS_TRAINING = """lt AS (
  SELECT user_id AS user_idx, item_id AS item_idx, 1 AS label, """ + LOG_WEIGHT + """ AS weight,
         CASE WHEN MAX(price) OVER () = MIN(price) OVER () THEN 0.5
              ELSE (price - MIN(price) OVER ()) / (MAX(price) OVER () - MIN(price) OVER ()) END AS price_norm,
         CASE WHEN category_id IS NULL THEN NULL ELSE LEAST(GREATEST(category_id, 1), 6) END AS category_idx
  FROM logs)"""

ORDER_ROWS = """oi AS (
  SELECT o.o_custkey AS user_idx, l.l_partkey AS item_idx, 1 AS label, CAST(l.l_quantity AS DOUBLE) AS weight,
         items.price, items.category_idx, o.o_orderdate AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN items ON l.l_partkey = items.item_id)"""

STAT_AGGS = ("COUNT(*) AS n_records, COUNT(DISTINCT user_idx) AS n_users, COUNT(DISTINCT item_idx) AS n_items, "
             "COUNT(*) FILTER (WHERE label = 1) AS n_positive, COUNT(*) FILTER (WHERE label = 0) AS n_negative, "
             "AVG(weight) AS avg_weight")
STAT_NAMES = ("n_records", "n_users", "n_items", "n_positive", "n_negative", "avg_weight")

register("enrich_events", with_(ITEMS, EV) + """
SELECT ev.event_id, ev.user_id, ev.item_id, ev.action, items.price, items.title, items.category_idx
FROM ev LEFT JOIN items ON ev.item_id = items.item_id""")

register("action_weight", with_(ITEMS, EV, LOGS) + f"SELECT event_id, action, {LOG_WEIGHT} AS weight FROM logs")

register("action_label", with_(EV) + """
SELECT event_id, action, CASE WHEN action IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS label FROM ev""")

register("cast_ids", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id
FROM events""")

register("clip_category", with_(*BASE) + """
SELECT event_id, category_idx - 1 AS category_raw,
       CASE WHEN category_idx - 1 IS NULL THEN NULL ELSE LEAST(GREATEST(category_idx - 1, 1), 6) END AS category_idx
FROM inter""")

register("minmax_price", with_(ITEMS, EV, LOGS) + """
SELECT event_id, ROUND(CASE WHEN MAX(price) OVER () = MIN(price) OVER () THEN 0.5
  ELSE (price - MIN(price) OVER ()) / (MAX(price) OVER () - MIN(price) OVER ()) END, 6) AS price_norm FROM logs""")

register("zscore_price", with_(*BASE, PSTATS, ROWS) + "SELECT event_id, ROUND(price_norm, 6) AS price_norm FROM trows")

register("label_encode", with_(EV) + """
SELECT 'user' AS kind, id, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS idx
FROM (SELECT DISTINCT user_id AS id FROM ev WHERE user_id IS NOT NULL)
UNION ALL
SELECT 'item' AS kind, id, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS idx
FROM (SELECT DISTINCT item_id AS id FROM ev WHERE item_id IS NOT NULL)""")

register("dense_encode", with_(ITEMS, ORDER_ROWS) + """
SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS item_code FROM (SELECT DISTINCT item_idx FROM oi)""")

register("decode_category", with_(*BASE) + """
SELECT event_id, category_idx,
       CASE category_idx WHEN 1 THEN '식품' WHEN 2 THEN '생활/주방' WHEN 3 THEN '뷰티/미용'
                         WHEN 4 THEN '패션' WHEN 5 THEN '건강/운동' WHEN 6 THEN '유아' END AS category_name
FROM inter""")

register("project_training_columns", with_(ITEMS, EV, LOGS, LOGS_TRAINING, dedup_cte("dd", "lt")) +
         f"SELECT {D4_OUT} FROM dd")

# non-numeric user ids; rows without one are left out before the price range is taken
STRING_LOGS = """slogs AS (SELECT * REPLACE (CASE WHEN CAST(user_id AS BIGINT) % 97 <> 0 THEN 'user_' || user_id END AS user_id) FROM logs)"""
register("string_user_logs", with_(ITEMS, EV, LOGS, STRING_LOGS, LOGS_TRAINING.replace("FROM logs)", "FROM slogs WHERE user_id IS NOT NULL)"),
                                   dedup_cte("dd", "lt")) + f"SELECT {D4_OUT} FROM dd")
register("logs_without_ids", with_(ITEMS, EV, LOGS, STRING_LOGS) +
         "SELECT item_id, COUNT(*) AS n_rows FROM slogs WHERE user_id IS NULL OR item_id IS NULL GROUP BY item_id")

register("validate_columns", with_(ITEMS, EV, LOGS) +
         "SELECT timestamp, item_id, user_id, action, category_id, price FROM logs")

register("filter_category", with_(*TRAIN_BASE) + f"SELECT {D4_OUT} FROM train WHERE category_idx = 3")

register("filter_active_users", with_(ITEMS, ORDER_ROWS) + """
SELECT user_idx, COUNT(*) AS n_rows FROM oi GROUP BY user_idx HAVING COUNT(*) >= 3""")

register("popularity_weight_sum", with_(*TRAIN_BASE) + """
SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS weight_sum FROM train WHERE item_idx IS NOT NULL
GROUP BY item_idx ORDER BY weight_sum DESC, item_idx LIMIT 20""")

register("popularity_weight_sum_category", with_(*TRAIN_BASE) + """
SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS weight_sum FROM train WHERE category_idx = 2 AND item_idx IS NOT NULL
GROUP BY item_idx ORDER BY weight_sum DESC, item_idx LIMIT 10""")

register("popularity_count", with_(*TRAIN_BASE) + """
SELECT item_idx, COUNT(*) AS n_interactions FROM (SELECT * FROM val UNION ALL SELECT * FROM test)
WHERE item_idx IS NOT NULL GROUP BY item_idx ORDER BY n_interactions DESC, item_idx LIMIT 20""")

register("user_item_sets", with_(*TRAIN_BASE) + "SELECT user_idx, item_idx, COUNT(*) AS n FROM train GROUP BY 1, 2")

register("dataset_stats", with_(*TRAIN_BASE) + f"""
SELECT split, {STAT_AGGS.replace('AVG(weight) AS avg_weight', 'ROUND(AVG(weight), 6) AS avg_weight')}
FROM splits GROUP BY split""")

register("system_stats", with_(*TRAIN_BASE) + """
SELECT COUNT(*) AS train_rows, COUNT(DISTINCT user_idx) AS n_users, COUNT(DISTINCT item_idx) AS n_items,
       COUNT(DISTINCT category_idx) AS n_categories FROM train""")

_unpivot = lambda src: " UNION ALL ".join(
    f"SELECT '{n}' AS statistic, CAST({n} AS DOUBLE) AS v FROM {src}" for n in STAT_NAMES)
register("compare_before_after", with_(*TRAIN_BASE, """both_ AS (
  SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM train
  UNION ALL SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM val)""",
                                        dedup_cte("after_", "both_"),
                                        f"sb AS (SELECT {STAT_AGGS} FROM train)",
                                        f"sa AS (SELECT {STAT_AGGS} FROM after_)",
                                        f"lb AS ({_unpivot('sb')})", f"la AS ({_unpivot('sa')})") + """
SELECT lb.statistic, ROUND(lb.v, 6) AS before, ROUND(la.v, 6) AS after, ROUND(la.v - lb.v, 6) AS delta
FROM lb JOIN la ON lb.statistic = la.statistic""")

register("value_distribution", with_(*TRAIN_BASE) + """
SELECT 'action' AS column_name, action AS value, COUNT(*) AS n FROM ev GROUP BY action
UNION ALL
SELECT 'category_idx' AS column_name, CAST(category_idx AS VARCHAR) AS value, COUNT(*) AS n FROM train GROUP BY category_idx""")

register("item_attributes", with_(*TRAIN_BASE, """cnt AS (SELECT item_idx, category_idx, COUNT(*) AS c FROM train GROUP BY 1, 2)""",
                                  """md AS (SELECT item_idx, category_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY c DESC, category_idx) AS rn FROM cnt) WHERE rn = 1)""",
                                  "av AS (SELECT item_idx, AVG(price_norm) AS p FROM train GROUP BY 1)") + """
SELECT av.item_idx, ROUND(av.p, 6) AS price_norm, md.category_idx FROM av JOIN md ON av.item_idx = md.item_idx""")

register("dedup_max_weight", with_(*TRAIN_BASE, dedup_cte("dd", "train")) + f"SELECT {D4_OUT} FROM dd")

register("distinct_item_meta", with_(*TRAIN_BASE) +
         "SELECT DISTINCT item_idx, category_idx, ROUND(price_norm, 6) AS price_norm FROM train")

register("time_quantiles", with_(*BASE, PSTATS, ROWS) + """
SELECT CAST(quantile_cont(epoch_us(ts), 0.7) AS DOUBLE) AS q70_us, CAST(quantile_cont(epoch_us(ts), 0.85) AS DOUBLE) AS q85_us
FROM trows""")

register("temporal_split", with_(*TRAIN_BASE) + "SELECT event_id, split FROM splits")

register("random_split", with_(*BASE, PSTATS, ROWS, dedup_cte("dd", "trows"), """h AS (
  SELECT user_idx, item_idx,
         row_number() OVER (ORDER BY md5(concat_ws('|', CAST(user_idx AS VARCHAR), CAST(item_idx AS VARCHAR), '42')),
                            user_idx, item_idx) - 1 AS pos,
         COUNT(*) OVER () AS n
  FROM dd)""") + """
SELECT user_idx, item_idx,
       CASE WHEN pos < floor(CAST(n AS DOUBLE) * 0.7) THEN 'train'
            WHEN pos < floor(CAST(n AS DOUBLE) * 0.7) + floor(CAST(n AS DOUBLE) * 0.15) THEN 'val'
            ELSE 'test' END AS split
FROM h""")

# new log rows on the stored price statistics
LOGS_ZSCORE = """ltz AS (
  SELECT user_id AS user_idx, item_id AS item_idx, 1 AS label, """ + LOG_WEIGHT + """ AS weight,
         (price - pstats.mean) / CASE WHEN pstats.std = 0 THEN 1 ELSE pstats.std END AS price_norm,
         CASE WHEN category_id IS NULL THEN NULL ELSE LEAST(GREATEST(category_id, 1), 6) END AS category_idx
  FROM logs, pstats)"""

TRAIN_AND_NEW = """both_ AS (
  SELECT CAST(user_idx AS VARCHAR) AS user_idx, item_idx, label, weight, price_norm, category_idx FROM train
  UNION ALL SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM newrows)"""

register("merge_new_data", with_(*TRAIN_BASE, LOGS, LOGS_ZSCORE, dedup_cte("newrows", "ltz"), TRAIN_AND_NEW,
                                 dedup_cte("merged", "both_")) + f"SELECT {D4_OUT} FROM merged")

register("union_splits", with_(*TRAIN_BASE) +
         "SELECT event_id, user_idx, item_idx, split FROM splits WHERE split IN ('val', 'test')")

register("sort_by_time", """
SELECT event_id, epoch_us(ts) AS ts_us, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS position FROM events""")


# --------------------------------------------------------------------------- candidates / serving
CATALOG_TRAIN = """train AS (
  SELECT user_idx, item_idx, label, weight, (price - pstats.mean) / CASE WHEN pstats.std = 0 THEN 1 ELSE pstats.std END AS price_norm, category_idx
  FROM oi, pstats)"""
CATALOG_BASE = (ITEMS, PSTATS, ORDER_ROWS, CATALOG_TRAIN)

REQ = """nsh AS (SELECT CAST(ceil(COUNT(*) / 400.0) AS BIGINT) AS n FROM items),
shelf AS (SELECT item_id % nsh.n AS s, list(item_id ORDER BY item_id) AS available_items FROM items, nsh GROUP BY 1),
req AS (
  SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN -1 - c_custkey ELSE c_custkey END AS user_id, 10 AS top_n,
         CASE WHEN c_nationkey < 6 THEN c_nationkey + 1 END AS category_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 11 WHEN 'FURNITURE' THEN 96 ELSE 1 END AS rank, available_items
  FROM customer CROSS JOIN nsh JOIN shelf ON shelf.s = c_custkey % nsh.n),
ri AS (SELECT DISTINCT * FROM (
  SELECT request_id, user_id, top_n, category_id, rank, CAST(unnest(available_items) AS BIGINT) AS item_idx FROM req)),
known AS (SELECT DISTINCT user_idx FROM train),
kri AS (SELECT * FROM ri WHERE user_id IN (SELECT user_idx FROM known)),
uri AS (SELECT * FROM ri WHERE user_id NOT IN (SELECT user_idx FROM known))"""

EMB = """emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nemb AS (SELECT COUNT(*) AS n FROM embeddings)"""

MF = """trained AS (SELECT DISTINCT item_idx FROM train),
catit AS (SELECT DISTINCT item_idx, category_idx FROM train WHERE category_idx IS NOT NULL),
bought AS (SELECT DISTINCT user_idx, item_idx FROM train WHERE weight = 5),
c0 AS (
  SELECT kri.* FROM kri
  WHERE item_idx IN (SELECT item_idx FROM trained)
    AND (category_id IS NULL OR EXISTS (SELECT 1 FROM catit WHERE catit.item_idx = kri.item_idx
                                                               AND catit.category_idx = kri.category_id))
    AND NOT EXISTS (SELECT 1 FROM bought WHERE bought.user_idx = kri.user_id AND bought.item_idx = kri.item_idx)),
sc AS (
  SELECT c0.*, list_dot_product(ue.v, ie.v) AS mf_score
  FROM c0 CROSS JOIN nemb JOIN emb ue ON ue.vec_id = c0.user_id % nemb.n JOIN emb ie ON ie.vec_id = c0.item_idx % nemb.n),
mfk AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY mf_score DESC, item_idx) AS INTEGER) AS mf_rank
        FROM sc),
meta AS (SELECT item_idx, category_idx, price_norm FROM (
  SELECT item_idx, category_idx, price_norm,
         row_number() OVER (PARTITION BY item_idx ORDER BY category_idx, price_norm) AS _rn FROM train) WHERE _rn = 1)"""

RANKED = """cand AS (
  SELECT mfk.request_id, mfk.item_idx, mfk.mf_score, meta.category_idx, meta.price_norm,
         1.0 / (1.0 + exp(-(meta.price_norm - mfk.mf_score / 4.0))) AS ranker_score
  FROM mfk JOIN meta ON mfk.item_idx = meta.item_idx WHERE mfk.mf_rank <= 250),
hyb AS (
  SELECT *, 0.6 * ranker_score + 0.4 * (CASE WHEN mf_score > 0 THEN mf_score / 10.0 ELSE 0 END) AS final_score,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY ranker_score DESC, item_idx) AS INTEGER) AS position
  FROM cand),
pop AS (SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS ws, COUNT(DISTINCT user_idx) AS nu, MIN(category_idx) AS category_idx
        FROM train WHERE item_idx IS NOT NULL GROUP BY item_idx),
psc AS (SELECT item_idx, category_idx,
               0.7 * (ws / MAX(ws) OVER ()) + 0.3 * (nu / CAST(MAX(nu) OVER () AS DOUBLE)) AS popularity_score FROM pop),
popr AS (
  SELECT uri.request_id, uri.item_idx, psc.popularity_score,
         CAST(row_number() OVER (PARTITION BY uri.request_id ORDER BY psc.popularity_score DESC, uri.item_idx) AS INTEGER) AS position
  FROM uri JOIN psc ON uri.item_idx = psc.item_idx
  WHERE uri.category_id IS NULL OR uri.category_id = psc.category_idx),
ranked AS (SELECT request_id, item_idx, position FROM hyb WHERE position <= 100
           UNION ALL SELECT request_id, item_idx, position FROM popr WHERE position <= 100),
nres AS (SELECT request_id, COUNT(*) AS n FROM ranked GROUP BY request_id),
rq AS (SELECT req.request_id, req.user_id, req.top_n, COALESCE(req.rank, 1) AS st, len(req.available_items) AS na,
              COALESCE(nres.n, 0) AS n
       FROM req LEFT JOIN nres ON req.request_id = nres.request_id WHERE len(req.available_items) > 0),
rq2 AS (SELECT *, LEAST(top_n, GREATEST(0, n - st + 1)) AS pl FROM rq),
resp AS (
  SELECT rq2.request_id, rq2.user_id, CAST(ranked.position AS INTEGER) AS rank, ranked.item_idx AS item_id,
         (st + pl - 1) < na AS has_next, (st + pl - 1) < n AS has_more_results, 'ok' AS status
  FROM rq2 LEFT JOIN ranked ON ranked.request_id = rq2.request_id AND ranked.position >= rq2.st
                            AND ranked.position < rq2.st + rq2.top_n)"""

SERVE_BASE = CATALOG_BASE + (REQ, EMB, MF)

register("filter_available_items", with_(*CATALOG_BASE, REQ) +
         "SELECT request_id, item_idx FROM ri WHERE item_idx IN (SELECT item_idx FROM train)")

register("exclude_purchased", with_(*CATALOG_BASE, REQ, "bought AS (SELECT DISTINCT user_idx, item_idx FROM train WHERE weight = 5)") + """
SELECT request_id, item_idx FROM kri
WHERE NOT EXISTS (SELECT 1 FROM bought WHERE bought.user_idx = kri.user_id AND bought.item_idx = kri.item_idx)""")

register("exclude_seen", with_(*CATALOG_BASE, REQ, "seen AS (SELECT DISTINCT user_idx, item_idx FROM train)") + """
SELECT request_id, item_idx FROM kri
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_idx = kri.user_id AND seen.item_idx = kri.item_idx)""")

register("user_item_scores", with_(*CATALOG_BASE, REQ, EMB) + """
SELECT kri.request_id, kri.item_idx, ROUND(list_dot_product(ue.v, ie.v), 6) AS score
FROM kri CROSS JOIN nemb JOIN emb ue ON ue.vec_id = kri.user_id % nemb.n JOIN emb ie ON ie.vec_id = kri.item_idx % nemb.n""")

register("mf_top_k", with_(*SERVE_BASE, """wsum AS (
  SELECT category_idx AS c, item_idx, CAST(SUM(weight) AS DOUBLE) AS s FROM train WHERE item_idx IS NOT NULL GROUP BY category_idx, item_idx),
lists AS (
  SELECT c, item_idx, s, CAST(row_number() OVER (PARTITION BY c ORDER BY s DESC, item_idx) AS INTEGER) AS r FROM wsum WHERE c IS NOT NULL
  UNION ALL
  SELECT NULL, item_idx, SUM(s), CAST(row_number() OVER (ORDER BY SUM(s) DESC, item_idx) AS INTEGER) FROM wsum GROUP BY item_idx)""") + """
SELECT request_id, item_idx, ROUND(mf_score, 6) AS mf_score, mf_rank FROM mfk WHERE mf_rank <= 250
UNION ALL
SELECT req.request_id, lists.item_idx, ROUND(lists.s, 6), lists.r
FROM req JOIN lists ON req.category_id IS NOT DISTINCT FROM lists.c
WHERE lists.r <= 250 AND req.user_id NOT IN (SELECT user_idx FROM known)""")

register("lookup_item_meta", with_(*SERVE_BASE) + """
SELECT mfk.request_id, mfk.item_idx, meta.category_idx, ROUND(meta.price_norm, 6) AS price_norm
FROM mfk JOIN meta ON mfk.item_idx = meta.item_idx WHERE mfk.mf_rank <= 250""")

register("lookup_mf_score", with_(*SERVE_BASE) + """
SELECT f.request_id, f.item_idx, ROUND(COALESCE(t.mf_score, 0.0), 6) AS mf_score
FROM (SELECT * FROM mfk WHERE mf_rank <= 250) f
LEFT JOIN (SELECT * FROM mfk WHERE mf_rank <= 10) t ON f.request_id = t.request_id AND f.item_idx = t.item_idx""")

register("route_known_users", with_(*CATALOG_BASE, REQ) +
         "SELECT request_id, user_id, user_id IN (SELECT user_idx FROM known) AS known FROM req")

register("uninteracted_items", with_(*TRAIN_BASE) + """
SELECT user_idx, (SELECT COUNT(DISTINCT item_idx) FROM train) - COUNT(DISTINCT item_idx) AS n_uninteracted
FROM train GROUP BY user_idx""")

register("hybrid_recommend", with_(*SERVE_BASE, RANKED) + """
SELECT request_id, item_idx, position, ROUND(ranker_score, 6) AS ranker_score, ROUND(mf_score, 6) AS mf_score,
       ROUND(final_score, 6) AS final_score
FROM hyb WHERE position <= 100""")

register("rerank", with_(*SERVE_BASE, RANKED) + """
SELECT request_id, item_idx, position, ROUND(ranker_score, 6) AS ranker_score FROM hyb WHERE position <= 250""")

register("popularity_per_request", with_(*SERVE_BASE, RANKED) + """
SELECT request_id, item_idx, position, ROUND(popularity_score, 6) AS popularity_score FROM popr WHERE position <= 100""")

register("recommend_batch", with_(*SERVE_BASE, RANKED) + "SELECT * FROM resp")

register("paginate", with_(*SERVE_BASE, RANKED) + "SELECT request_id, rank, item_id, has_next FROM resp")

register("simplify_response", with_(*TRAIN_BASE, REQ, EMB, MF, RANKED) + """
SELECT item_idx AS item_id, CAST(row_number() OVER (ORDER BY popularity_score DESC, item_idx) AS INTEGER) AS rank
FROM psc QUALIFY rank <= 50""")

CONTENT = """hist AS (SELECT user_idx, item_idx, weight FROM splits WHERE split IN ('val', 'test')),
vecs AS (SELECT vec_id AS item_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
         WHERE vec_id IN (SELECT item_id FROM items)),
ui AS (SELECT DISTINCT h.user_idx, h.item_idx FROM hist h JOIN vecs ON h.item_idx = vecs.item_idx),
pe AS (SELECT user_idx, d, AVG(x) AS m FROM (
  SELECT ui.user_idx, generate_subscripts(vecs.v, 1) AS d, unnest(vecs.v) AS x
  FROM ui JOIN vecs ON ui.item_idx = vecs.item_idx) GROUP BY user_idx, d),
prof AS (SELECT user_idx, list(m ORDER BY d) AS p FROM pe GROUP BY user_idx),
cust AS (SELECT DISTINCT c_custkey AS user_idx FROM customer),
sims AS (SELECT prof.user_idx, vecs.item_idx, list_cosine_similarity(prof.p, vecs.v) AS s
         FROM prof JOIN cust ON prof.user_idx = cust.user_idx CROSS JOIN vecs),
near AS (SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY s DESC, item_idx) AS INTEGER) AS rank,
                item_idx, s AS score, 'content_based' AS reason
         FROM sims WHERE s > 0 AND NOT EXISTS (
           SELECT 1 FROM hist WHERE hist.user_idx = sims.user_idx AND hist.item_idx = sims.item_idx)),
popw AS (SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS score,
                CAST(row_number() OVER (ORDER BY SUM(weight) DESC, item_idx) AS INTEGER) AS rank
         FROM hist WHERE item_idx IS NOT NULL GROUP BY item_idx),
popc AS (SELECT item_idx, CAST(COUNT(*) AS DOUBLE) AS score,
                CAST(row_number() OVER (ORDER BY COUNT(*) DESC, item_idx) AS INTEGER) AS rank
         FROM hist WHERE item_idx IS NOT NULL GROUP BY item_idx),
newu AS (SELECT user_idx FROM cust WHERE user_idx NOT IN (SELECT user_idx FROM hist)),
novec AS (SELECT user_idx FROM cust WHERE user_idx IN (SELECT user_idx FROM hist)
                                      AND user_idx NOT IN (SELECT user_idx FROM prof))"""

register("content_based", with_(*TRAIN_BASE, CONTENT) + """
SELECT user_idx, rank, item_idx, ROUND(score, 6) AS score, reason FROM near WHERE rank <= 5
UNION ALL
SELECT newu.user_idx, popw.rank, popw.item_idx, ROUND(popw.score, 6) AS score, 'popular_item' AS reason
FROM newu CROSS JOIN popw WHERE popw.rank <= 5
UNION ALL
SELECT novec.user_idx, popc.rank, popc.item_idx, ROUND(popc.score, 6) AS score, 'fallback_popular' AS reason
FROM novec CROSS JOIN popc WHERE popc.rank <= 5""")

register("user_profile_vector", with_(*TRAIN_BASE, """hist AS (SELECT user_idx, item_idx FROM splits WHERE split IN ('val', 'test')),
vecs AS (SELECT vec_id AS item_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ui AS (SELECT DISTINCT h.user_idx, h.item_idx FROM hist h JOIN vecs ON h.item_idx = vecs.item_idx)""") + """
SELECT user_idx, CAST(d - 1 AS INTEGER) AS d, ROUND(AVG(x), 6) AS v FROM (
  SELECT ui.user_idx, generate_subscripts(vecs.v, 1) AS d, unnest(vecs.v) AS x
  FROM ui JOIN vecs ON ui.item_idx = vecs.item_idx) GROUP BY user_idx, d""")

# --------------------------------------------------------------------------- metrics on given rankings
METRIC_BASE = """pop AS (SELECT item_idx, CAST(SUM(weight) AS DOUBLE) AS ws, COUNT(DISTINCT user_idx) AS nu
        FROM train WHERE item_idx IS NOT NULL GROUP BY item_idx),
psc AS (SELECT item_idx, 0.7 * (ws / MAX(ws) OVER ()) + 0.3 * (nu / CAST(MAX(nu) OVER () AS DOUBLE)) AS popularity_score FROM pop),
top20 AS (SELECT item_idx, row_number() OVER (ORDER BY popularity_score DESC, item_idx) AS rank FROM psc QUALIFY rank <= 20),
vu AS (SELECT DISTINCT user_idx FROM val),
recs AS (SELECT vu.user_idx, top20.item_idx, top20.rank FROM vu CROSS JOIN top20),
relset AS (SELECT DISTINCT user_idx, item_idx FROM val),
nrel AS (SELECT user_idx, COUNT(*) AS n_relevant FROM val GROUP BY user_idx),
hits AS (SELECT recs.user_idx, recs.rank, CASE WHEN relset.item_idx IS NULL THEN 0 ELSE 1 END AS hit
         FROM recs LEFT JOIN relset ON recs.user_idx = relset.user_idx AND recs.item_idx = relset.item_idx),
ks AS (SELECT unnest([5, 10, 20]) AS k),
disc AS (SELECT i, SUM(1.0 / log2(i + 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
         FROM range(1, 1001) t(i)),
per AS (SELECT hits.user_idx, ks.k, CAST(SUM(hit) AS DOUBLE) AS hits, CAST(SUM(hit / log2(rank + 1)) AS DOUBLE) AS dcg
        FROM hits JOIN ks ON hits.rank <= ks.k GROUP BY hits.user_idx, ks.k),
per2 AS (SELECT per.*, nrel.n_relevant, COALESCE(disc.cum, 0.0) AS idcg
         FROM per JOIN nrel ON per.user_idx = nrel.user_idx LEFT JOIN disc ON disc.i = LEAST(per.k, nrel.n_relevant)),
metrics AS (SELECT user_idx, k, hits / k AS precision,
                   CASE WHEN n_relevant = 0 THEN 0.0 ELSE hits / n_relevant END AS recall, dcg,
                   CASE WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg,
                   CAST(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hit_rate
            FROM per2)"""

for _m in ("precision", "recall", "dcg", "ndcg", "hit_rate"):
    register(f"{_m}_at_k", with_(*TRAIN_BASE, METRIC_BASE) +
             f"SELECT user_idx, ROUND(CAST({_m} AS DOUBLE), 6) AS {_m} FROM metrics WHERE k = 10")

register("evaluate", with_(*TRAIN_BASE, METRIC_BASE) + """
SELECT CAST(k AS INTEGER) AS k, ROUND(AVG(precision), 6) AS precision, ROUND(AVG(recall), 6) AS recall,
       ROUND(AVG(ndcg), 6) AS ndcg, ROUND(AVG(hit_rate), 6) AS hit_rate, COUNT(*) AS evaluated_users,
       (SELECT COUNT(DISTINCT user_idx) FROM val) AS total_users
FROM metrics GROUP BY k""")


# --------------------------------------------------------------------------- sources / sinks (round trips)
LOGS_D = """logs_d AS (SELECT logs.*, strftime(to_timestamp(logs.timestamp / 1000.0), '%Y-%m-%d') AS day FROM logs)"""
LOG_COLS = "timestamp, item_id, user_id, action, category_id, price"

register("read_interactions_csv", with_(*TRAIN_BASE) + f"SELECT {D4_STRING}, split FROM splits")

register("write_splits", with_(*TRAIN_BASE) + "SELECT split, COUNT(*) AS n_rows FROM splits GROUP BY split")

register("read_json_logs", with_(ITEMS, EV, LOGS) + f"SELECT {LOG_COLS} FROM logs")

register("write_logs_json", with_(ITEMS, EV, LOGS, LOGS_D) + f"SELECT day, {LOG_COLS} FROM logs_d")

register("read_json_lines", with_(ITEMS, EV, LOGS) + f"SELECT {LOG_COLS} FROM logs")

register("file_states", with_(ITEMS, EV, LOGS, LOGS_D) + """
SELECT day, 'done' AS state, CASE WHEN day <= '2024-01-05' THEN 1 ELSE 2 END::BIGINT AS attempts FROM (SELECT DISTINCT day FROM logs_d)""")

register("discover_log_files", with_(ITEMS, EV, LOGS, LOGS_D) +
         "SELECT day, CAST(COUNT(DISTINCT day) AS BIGINT) AS n_files FROM logs_d WHERE day LIKE '2024-01%' GROUP BY day")

register("skip_processed", with_(ITEMS, EV, LOGS, LOGS_D) + f"SELECT {LOG_COLS} FROM logs_d WHERE day > '2024-01-05'")

register("latest_unprocessed_files", with_(ITEMS, EV, LOGS, LOGS_D) + f"""
SELECT {LOG_COLS} FROM logs_d
WHERE day IN (SELECT day FROM (SELECT DISTINCT day FROM logs_d WHERE day > '2024-01-05') ORDER BY day DESC LIMIT 10)""")

register("logs_by_date_range", with_(ITEMS, EV, LOGS, LOGS_D) + f"""
SELECT {LOG_COLS} FROM logs_d
WHERE day > '2024-01-05' AND timestamp BETWEEN 1704844800000 AND 1705363199999""")

register("filter_by_timestamp", with_(ITEMS, EV, LOGS) +
         "SELECT event_id, timestamp FROM logs WHERE timestamp BETWEEN 1704844800000 AND 1705363199999")

register("snapshot_before_overwrite", with_(*TRAIN_BASE, """both_ AS (
  SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM train
  UNION ALL SELECT user_idx, item_idx, label, weight, price_norm, category_idx FROM val)""",
                                             dedup_cte("after_", "both_")) + f"SELECT {D4_OUT} FROM after_")

register("write_encoders", with_(*BASE, PSTATS, ROWS) + """
SELECT 'user' AS kind, id, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS idx
FROM (SELECT DISTINCT user_idx AS id FROM trows WHERE user_idx IS NOT NULL)
UNION ALL
SELECT 'item' AS kind, id, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS idx
FROM (SELECT DISTINCT item_idx AS id FROM trows WHERE item_idx IS NOT NULL)""")

register("read_embeddings", """
SELECT vec_id AS item_idx, CAST(len(embedding) AS INTEGER) AS n_dims,
       ROUND(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm
FROM embeddings""")

# --------------------------------------------------------------------------- negative-sampling quotas
QUOTA = """pu AS (SELECT user_idx, COUNT(DISTINCT item_idx) AS p FROM train GROUP BY user_idx),
cat AS (SELECT COUNT(DISTINCT item_idx) AS c FROM train)"""

def _feistel(x: str, source: str, out: str) -> str:
    """CTEs that send ``x`` of ``source`` (with keys k0..k7 and sides a, b) one step along its cycle, into column ``out``."""
    def mix(v: str, i: int) -> str:
        return f"({v} * (k{2 * i} + 1) + k{2 * i + 1}) % 2147483647 // 128"
    return (f"SELECT *, hi2 * b + (lo1 + {mix('hi2', 3)}) % b AS {out} FROM ("
            f"SELECT *, (hi1 + {mix('lo1', 2)}) % a AS hi2 FROM ("
            f"SELECT *, (lo0 + {mix('hi1', 1)}) % b AS lo1 FROM ("
            f"SELECT *, (hi0 + {mix('lo0', 0)}) % a AS hi1 FROM ("
            f"SELECT *, {x} // b AS hi0, {x} % b AS lo0 FROM {source}))))")


def negatives_cte(n: int) -> str:
    """``negs``: per user the first least(n * p, c - p) non-positive places of its permutation of the items in id order."""
    hexes = ", ".join(f"CAST('0x' || substr(sha256(CAST(user_idx AS VARCHAR) || '|42'), {1 + 7 * i}, 7) AS BIGINT) AS k{i}" for i in range(8))
    return f"""items_at AS (SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS iid FROM (SELECT DISTINCT item_idx FROM train)),
sized AS (SELECT COUNT(*) AS c, CAST(floor(sqrt(COUNT(*))) AS BIGINT) AS a FROM items_at),
shape AS (SELECT c, a, (c + a - 1) // a AS b FROM sized),
starts AS (
  SELECT user_idx, {hexes}, c, a, b, j, j AS x, 0 AS step
  FROM (SELECT DISTINCT user_idx FROM train), shape, (SELECT iid AS j FROM items_at)),
paths AS (
  SELECT * FROM starts
  UNION ALL
  SELECT user_idx, k0, k1, k2, k3, k4, k5, k6, k7, c, a, b, j, y AS x, step + 1 AS step FROM ({_feistel("x", "paths", "y")}) WHERE step = 0 OR x >= c),
places AS (SELECT user_idx, j, iid, item_idx FROM paths JOIN items_at ON iid = x WHERE step > 0),
ours AS (SELECT DISTINCT user_idx, item_idx FROM train),
fresh AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.user_idx ORDER BY j) AS r
  FROM places p LEFT JOIN ours o ON o.user_idx = p.user_idx AND o.item_idx = p.item_idx WHERE o.item_idx IS NULL),
negs AS (SELECT f.user_idx, f.item_idx FROM fresh f JOIN pu USING (user_idx), cat WHERE r <= LEAST({n} * pu.p, cat.c - pu.p))"""


def with_recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


register("negatives_per_user", with_recursive(*TRAIN_BASE, QUOTA, negatives_cte(5)) + """
SELECT user_idx, item_idx, CAST(0 AS DOUBLE) AS weight, 0 AS label FROM negs""")

register("negatives_per_user_quota", with_(*TRAIN_BASE, QUOTA) + """
SELECT user_idx, LEAST(5 * p, c - p) AS n_negatives FROM pu, cat WHERE LEAST(5 * p, c - p) > 0""")

register("negatives_with_attributes", with_recursive(*TRAIN_BASE, QUOTA, negatives_cte(3), """attrs AS (
  SELECT item_idx, min({'category_idx': category_idx, 'price_norm': price_norm}) AS m FROM train GROUP BY item_idx)""") + """
SELECT user_idx, item_idx, label, weight, ROUND(price_norm, 6) AS price_norm, category_idx FROM train
UNION ALL
SELECT user_idx, item_idx, 0, 0.0, ROUND(m.price_norm, 6), m.category_idx FROM negs JOIN attrs USING (item_idx)""")

register("negatives_global_ratio", with_(*TRAIN_BASE) +
         "SELECT CAST(floor(CAST(COUNT(*) AS DOUBLE) * 0.2) AS BIGINT) AS n_negatives FROM train")

# --------------------------------------------------------------------------- model key sets
# models by facts: who has factors, what they satisfy, who is recommended how much
register("fit_mf", with_(*TRAIN_BASE) + "SELECT DISTINCT user_idx, 50 AS n_factors, true AS beats_mean FROM train")
register("fit_nmf", with_(*TRAIN_BASE) + "SELECT DISTINCT item_idx, 50 AS n_factors, true AS nonnegative, true AS in_use FROM train")
register("save_load_model", with_(*TRAIN_BASE) + "SELECT DISTINCT item_idx, 50 AS n_factors, true AS same FROM train")
# a user's rows and three negatives for each of them, as far as the items go round
register("fit_ranker", with_(*TRAIN_BASE) + """
SELECT user_idx, COUNT(*) + LEAST(3 * COUNT(*), (SELECT COUNT(DISTINCT item_idx) FROM train) - COUNT(DISTINCT item_idx)) AS n_scored,
       true AS in_range, true AS separates
FROM train GROUP BY user_idx""")
for _name in ("train_hybrid", "train_hybrid_mlp"):
    register(_name, with_(*TRAIN_BASE, "n AS (SELECT COUNT(DISTINCT item_idx) AS n FROM train)", """bought AS (
  SELECT user_idx, COUNT(DISTINCT item_idx) AS b FROM train WHERE weight = 5 GROUP BY user_idx),
k AS (SELECT user_idx, LEAST(50, LEAST(250, n.n - COALESCE(b, 0))) AS k FROM (SELECT DISTINCT user_idx FROM val) CROSS JOIN n LEFT JOIN bought USING (user_idx))""") + """
SELECT user_idx, CAST(k AS BIGINT) AS n_items, CAST(k AS BIGINT) AS n_distinct, CAST(k AS INTEGER) AS last_rank, CAST(0 AS BIGINT) AS n_bought
FROM k WHERE k > 0""")

# --------------------------------------------------------------------------- incremental = one-shot merge
register("incremental_update", with_(*TRAIN_BASE, LOGS, LOGS_ZSCORE, dedup_cte("newrows", "ltz"), TRAIN_AND_NEW,
                                     dedup_cte("merged", "both_")) + f"SELECT {D4_OUT} FROM merged")

_MERGED = (*TRAIN_BASE, LOGS, LOGS_ZSCORE, dedup_cte("newrows", "ltz"), TRAIN_AND_NEW, dedup_cte("merged", "both_"))

register("bucketed_update", with_(*_MERGED) + f"SELECT {D4_STRING} FROM merged")

register("update_job", with_(*_MERGED, dedup_cte("before_", "train"),
                             f"sb AS (SELECT {STAT_AGGS} FROM before_)", f"sa AS (SELECT {STAT_AGGS} FROM merged)",
                             f"lb AS ({_unpivot('sb')})", f"la AS ({_unpivot('sa')})") + """
SELECT lb.statistic, ROUND(lb.v, 6) AS before, ROUND(la.v, 6) AS after, ROUND(la.v - lb.v, 6) AS delta
FROM lb JOIN la ON lb.statistic = la.statistic""")

register("live_popularity", with_(*TRAIN_BASE, dedup_cte("merged", "splits"), """pop AS (
  SELECT item_idx, MIN(category_idx) AS category_idx, CAST(SUM(weight) AS DOUBLE) AS weight_sum, COUNT(DISTINCT user_idx) AS n_users, COUNT(*) AS n_interactions
  FROM merged GROUP BY item_idx),
sc AS (SELECT *, 0.7 * (weight_sum / MAX(weight_sum) OVER ()) + 0.3 * (n_users / CAST(MAX(n_users) OVER () AS DOUBLE)) AS s FROM pop),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY category_idx ORDER BY s DESC, item_idx) AS INTEGER) AS rank FROM sc)""") + """
SELECT category_idx, rank, item_idx, weight_sum, n_users, n_interactions, ROUND(s, 6) AS popularity_score FROM rk WHERE rank <= 10""")

register("live_statistics", with_(*_MERGED, f"sa AS (SELECT {STAT_AGGS} FROM merged)", f"la AS ({_unpivot('sa')})", """percat AS (
  SELECT COALESCE(CAST(category_idx AS VARCHAR), 'none') AS c, COUNT(*) AS n_rows, COUNT(DISTINCT item_idx) AS n_items,
         COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
  FROM merged GROUP BY category_idx)""") + """
SELECT statistic, ROUND(v, 6) AS value FROM la
UNION ALL SELECT 'n_rows of category ' || c, CAST(n_rows AS DOUBLE) FROM percat
UNION ALL SELECT 'n_items of category ' || c, CAST(n_items AS DOUBLE) FROM percat
UNION ALL SELECT 'share of category ' || c, ROUND(share, 6) FROM percat""")

register("category_distribution", with_(*TRAIN_BASE) + """
SELECT split, category_idx, COUNT(*) AS n_rows, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY split) AS DOUBLE), 6) AS share
FROM splits GROUP BY split, category_idx""")

register("model_stats", with_(*TRAIN_BASE) + """
SELECT 50 AS model_rank, COUNT(DISTINCT user_idx) FILTER (WHERE split = 'train') AS model_users,
       COUNT(DISTINCT item_idx) FILTER (WHERE split = 'train') AS model_items,
       COUNT(DISTINCT user_idx) - COUNT(DISTINCT user_idx) FILTER (WHERE split = 'train') AS unknown_users,
       COUNT(DISTINCT item_idx) - COUNT(DISTINCT item_idx) FILTER (WHERE split = 'train') AS unknown_items
FROM splits""")
