"""F1-F4: log transform, merge, enrichment, encoders, price scaling."""
import json
import os

import pytest
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.operators import prepare as P
from marmot.sources import files as FS


def _logs(spark, rows):
    return spark.createDataFrame(rows, S.LOG_SCHEMA)


def test_f1_transform_basic(spark):
    # by hand: prices 40..100 scale to 0..1, user 8 keeps the heavier of two actions on item 500
    logs = _logs(spark, [(10, 500, "8", "CLICK", 2, 70.0), (20, 500, "8", "ADD_CART", 2, 70.0),
                         (30, 600, "9", "VIEW", 4, 40.0), (40, 700, "9", "PURCHASE", 6, 100.0)])
    out = sorted(tuple(r) for r in P.logs_to_training(logs).collect())
    assert out == [("8", 500, 1, 3.0, 0.5, 2), ("9", 600, 1, 1.0, 0.0, 4), ("9", 700, 1, 5.0, 1.0, 6)]


def test_string_users_stay_apart(spark):
    logs = _logs(spark, [(1, 31, "newUser", "VIEW", 1, 5.0), (2, 31, "guest", "VIEW", 1, 5.0), (3, 31, "user_1", "PURCHASE", 1, 5.0),
                         (4, 31, None, "VIEW", 1, 5.0), (5, None, "guest", "VIEW", 1, 5.0)])
    rows = {(r["user_idx"], r["item_idx"]): r["weight"] for r in P.logs_to_training(logs).collect()}
    assert rows == {("newUser", 31): 1.0, ("guest", 31): 1.0, ("user_1", 31): 5.0}
    assert P.rows_without_ids(logs).count() == 2
    existing = spark.createDataFrame([(1, 31, 1, 1.0, 0.5, 1)], "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    merged = {r["user_idx"] for r in P.merge(existing, P.logs_to_training(logs)).collect()}
    assert merged == {"1", "newUser", "guest", "user_1"}


def test_current_version_is_the_last_written(spark, tmp_dir):
    for v in ("v2", "v10"):
        FS.write_snapshot(spark.range(3), f"{tmp_dir}/snap", v)
    assert FS.current_version(spark, f"{tmp_dir}/snap") == "v10"


def test_f1_edge_rows(spark):
    logs = _logs(spark, [(1, 1, "7", "UNKNOWN", 0, 5.0), (2, 2, "7", "view", 9, 5.0), (None, 3, "7", "CLICK", None, 5.0)])
    out = {r["item_idx"]: r for r in P.logs_to_training(logs).collect()}
    assert out[1]["weight"] == 1.0 and out[1]["category_idx"] == 1      # unknown action, category 0 -> 1
    assert out[2]["weight"] == 1.0 and out[2]["category_idx"] == 6      # lower-case is not in the log vocabulary
    assert out[3]["category_idx"] is None                               # null category stays null (H3)
    assert all(r["price_norm"] == 0.5 for r in out.values())            # all prices equal -> 0.5


def test_f1_json_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "logs", "2025", "11")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump([{"timestamp": 1762003990140, "item_id": 31, "user_id": "1", "action": "VIEW", "category_id": 1,
                    "price": 20000},
                   {"timestamp": 1762004000000, "item_id": 45, "user_id": 2, "action": "CLICK", "category_id": 3,
                    "price": 10000}], f, indent=2)
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write("[]")
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write('[{"timestamp": 1, "item_id": ')  # truncated
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    good, bad = FS.read_logs(spark, os.path.join(tmp_dir, "logs"))
    rows = sorted((r["user_id"], r["item_id"]) for r in good.collect())
    assert rows == [("1", 31), ("2", 45)]                               # int user id read as string
    assert [r["file_path"].endswith("c.json") for r in bad.collect()] == [True]
    files = FS.list_log_files(spark, os.path.join(tmp_dir, "logs"), prefix="2025/1")
    assert files.count() == 3
    assert FS.list_log_files(spark, os.path.join(tmp_dir, "logs"), prefix="2025/2").count() == 0
    g2, _ = FS.read_logs(spark, os.path.join(tmp_dir, "logs"), prefix="2025/11")
    assert g2.count() == 2
    # newest keys c (bad) and b (empty) do not count toward n: the window grows to reach a
    rows0, chosen0 = FS.fetch_latest_logs(spark, os.path.join(tmp_dir, "logs"), FS.load_ledger(spark, "/nonexistent"), 1)
    assert [r["file_path"].endswith("a.json") for r in chosen0.collect()] == [True] and rows0.count() == 2
    # ledger: a.json processed -> nothing left with rows; b (empty) and c (bad) never count
    led = os.path.join(tmp_dir, "ledger")
    FS.mark_processed(good.select("file_path").distinct(), led)
    rows2, chosen = FS.latest_unprocessed(good, FS.load_ledger(spark, led), 10)
    assert rows2.count() == 0 and chosen.count() == 0
    rows3, chosen3 = FS.fetch_latest_logs(spark, os.path.join(tmp_dir, "logs"), FS.load_ledger(spark, led), 10)
    assert rows3.count() == 0 and chosen3.count() == 0


def test_filter_by_timestamp(spark):
    logs = _logs(spark, [(1000, 1, "1", "VIEW", 1, 1.0), (2000, 2, "1", "VIEW", 1, 1.0), (None, 3, "1", "VIEW", 1, 1.0)])
    assert logs.transform(lambda d: FS.filter_by_timestamp(d)).count() == 3           # no bounds: all rows
    assert FS.filter_by_timestamp(logs, 1000, 2000).count() == 2                      # inclusive both ends
    assert FS.filter_by_timestamp(logs, 1001).count() == 1                            # null ts dropped


def test_f2_merge_max_weight(spark):
    schema = "user_idx BIGINT, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT"
    existing = spark.createDataFrame([(1, 10, 1, 3.0, 0.1, 1), (1, 20, 1, 1.0, 0.2, 2)], schema)
    new = spark.createDataFrame([("201", 10, 1, 2.0, 0.5, 1), ("1", 10, 1, 5.0, 0.1, 1), ("1", 20, 1, 0.5, 0.2, 2)],
                                "user_idx STRING, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT")
    out = {(r["user_idx"], r["item_idx"]): r["weight"] for r in P.merge(existing, new).collect()}
    assert out == {("1", 10): 5.0, ("1", 20): 1.0, ("201", 10): 2.0}                        # "1" and 1 deduplicate (H2)
    with pytest.raises(ValueError):
        P.merge(existing, new.drop("weight"))


def test_f3_enrich_missing_item(spark):
    ev = spark.createDataFrame([("u1", 1), ("u1", 99)], "user_id STRING, item_id BIGINT")
    items = spark.createDataFrame([(1, 3, 500)], "item_id BIGINT, category_idx INT, price BIGINT")
    out = {r["item_id"]: r for r in P.enrich(ev, items).collect()}
    assert out[99]["price"] is None and out[99]["category_idx"] is None


def test_f4_label_encode_and_zscore(spark):
    df = spark.createDataFrame([(f"user_{i}",) for i in (1, 2, 10, 100, 11)], "user_id STRING")
    dim = {r["id"]: r["idx"] for r in P.fit_dim(df, "user_id").collect()}
    assert [k for k, _ in sorted(dim.items(), key=lambda kv: kv[1])] == ["user_1", "user_10", "user_100", "user_11", "user_2"]
    stats = spark.createDataFrame([(129073.554, 5490007847.815084 ** 0.5, 5490007847.815084)], "mean DOUBLE, std DOUBLE, var DOUBLE")
    z = P.zscore(spark.createDataFrame([(200000.0,)], "price DOUBLE"), stats).first()["price_norm"]
    assert round(z, 6) == 0.957242


def test_decode_category(spark):
    out = P.decode_category(spark.createDataFrame([(1,), (6,), (7,)], "category_idx INT")).collect()
    names = {r["category_idx"]: r["category_name"] for r in out}
    assert names[1] == S.CATEGORY_NAMES[1] and names[6] == S.CATEGORY_NAMES[6] and names[7] is None
