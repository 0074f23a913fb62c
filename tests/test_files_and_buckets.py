"""Listing by tasks, file states, and the bucketed training table."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from marmot.operators import prepare as P
from marmot.sources import files as FS
from marmot.sources import listing as L
from marmot.streaming import bucketed as BK

TRAINING = "user_idx STRING, item_idx BIGINT, label INT, weight DOUBLE, price_norm DOUBLE, category_idx INT"


def _put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def _row(ts, item, user, action="VIEW", price=100):
    return {"timestamp": ts, "item_id": item, "user_id": user, "action": action, "category_id": 1, "price": price}


def _names(df, root):
    return sorted(r["file_path"].split(root + "/")[1] for r in df.collect())


def test_listing_never_opens_pruned_folders(spark, tmp_dir):
    for k in ("2024/01/05/a.json", "2024/01/06/b.json", "2024/02/01/c.json", "2025/01/05/d.json", "top.json", "2024/01/06/_hidden.json", "2024/01/06/x.txt"):
        _put(f"{tmp_dir}/{k}", [])
    assert _names(L.list_files(spark, tmp_dir, ext=".json"), tmp_dir) == ["2024/01/05/a.json", "2024/01/06/b.json", "2024/02/01/c.json", "2025/01/05/d.json", "top.json"]
    assert _names(L.list_files(spark, tmp_dir, ext=".json", recursive=False), tmp_dir) == ["top.json"]
    assert _names(L.list_files(spark, tmp_dir, prefix="2024/0", max_files=2), tmp_dir) == ["2024/01/06/x.txt", "2024/02/01/c.json"]
    # a file in place of a folder to be listed would fail the job: these are never opened
    os.rename(f"{tmp_dir}/2025/01/05", f"{tmp_dir}/2025/01/moved")
    os.symlink("/nonexistent", f"{tmp_dir}/2025/01/05")
    got = L.list_files(spark, tmp_dir, prefix="2024/01", ext=".json", days=(dt.date(2024, 1, 6), None))
    assert _names(got, tmp_dir) == ["2024/01/06/b.json"]
    assert _names(L.list_files(spark, tmp_dir, prefix="nothing"), tmp_dir) == []
    assert "collect()" not in open(FS.__file__).read()


def test_failed_and_empty_files_are_tried_again(spark, tmp_dir):
    src, led = f"{tmp_dir}/src", f"{tmp_dir}/ledger"
    _put(f"{src}/1.json", [_row(1, 1, "a")])
    _put(f"{src}/2.json", "[{not json")
    _put(f"{src}/3.json", "[]")
    _put(f"{src}/4.json", " \n")
    os.makedirs(f"{src}/sub")
    with open(f"{src}/5.json", "wb") as f:
        f.write(b"\xff\xfe\x00")

    def run():
        files = FS.unprocessed(FS.list_log_files(spark, src), FS.load_ledger(spark, led))
        good, bad = FS.read_log_files(files)
        out = FS.outcome(files, good, bad).checkpoint(eager=True)
        n = good.count()
        FS.record(out, led)
        return n, {r["file_path"][-6:-5]: r["state"] for r in out.collect()}

    assert run() == (1, {"1": "done", "2": "failed", "3": "empty", "4": "empty", "5": "failed"})
    _put(f"{src}/2.json", [_row(2, 2, "b"), _row(3, 3, "c")])
    assert run() == (2, {"2": "done", "3": "empty", "4": "empty", "5": "failed"})
    assert run() == (0, {"3": "empty", "4": "empty", "5": "failed"})
    states = {r["file_path"][-6:-5]: (r["state"], r["attempts"]) for r in FS.file_states(FS.load_ledger(spark, led)).collect()}
    assert states == {"1": ("done", 1), "2": ("done", 2), "3": ("empty", 3), "4": ("empty", 3), "5": ("failed", 3)}


def test_json_arrays_in_files_of_bounded_size(spark, tmp_dir):
    rows = [(i, i % 7, f"u{i}", "VIEW", 1, float(i), f"d{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "timestamp BIGINT, item_id BIGINT, user_id STRING, action STRING, category_id INT, price DOUBLE, day STRING")
    FS.write_logs_json(df, f"{tmp_dir}/a", ["day"], layout="array", rows_per_file=50)
    files = FS.list_log_files(spark, f"{tmp_dir}/a", ext=".txt")
    assert files.count() >= 9
    good, bad = FS.read_log_files(files)
    assert bad.count() == 0
    got = sorted((r["timestamp"], r["item_id"], r["user_id"], r["price"], r["file_path"].split("day=")[1][:2]) for r in good.collect())
    assert got == sorted((r[0], r[1], r[2], r[5], r[6]) for r in rows)
    FS.write_logs_json(df.drop("day"), f"{tmp_dir}/b", layout="array", rows_per_file=100)
    assert FS.read_logs(spark, f"{tmp_dir}/b", ext=".txt")[0].count() == 500


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_batches_rewrite_only_their_buckets(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    base = spark.range(4000).select(F.concat(F.lit("u"), F.col("id") % 400).alias("user_idx"), (F.col("id") / 400).cast("bigint").alias("item_idx"),
                                    F.lit(1).alias("label"), F.lit(1.0).alias("weight"), F.rand(1).alias("price_norm"), F.lit(2).alias("category_idx"))
    base = base.select(*[F.col(c.split()[0]).cast(c.split()[1].lower()) for c in TRAINING.split(", ")]).checkpoint()
    assert BK.create(spark, root, base, buckets=32) == 0 and BK.create(spark, root, base) == 0
    new = spark.createDataFrame([("u3", 1, 1, 5.0, 0.5, 2), ("fresh", 9, 1, 2.0, 0.5, 3)], TRAINING)
    assert BK.merge_batch(spark, root, new, "one") == 1
    want = sorted(map(tuple, P.merge(base, new).collect()))
    assert sorted(map(tuple, BK.read(spark, root).collect())) == want
    assert _size(f"{root}/data/v=000000000001") < 0.25 * _size(f"{root}/data/v=000000000000")
    assert BK.merge_batch(spark, root, new, "one") == 1                          # a replay writes nothing
    assert BK.merge_batch(spark, root, new.where("false"), "none") == 1
    assert sorted(map(tuple, BK.read(spark, root, 0).collect())) == sorted(map(tuple, base.collect()))   # the backup
    second = spark.createDataFrame([("u3", 1, 1, 3.0, 0.5, 2), ("u4", 99, 1, 1.0, 0.1, 1)], TRAINING)
    assert BK.merge_batch(spark, root, second, "two") == 2
    want = sorted(map(tuple, P.merge(P.merge(base, new), second).collect()))
    assert sorted(map(tuple, BK.read(spark, root).collect())) == want
    BK.vacuum(spark, root, keep=1)
    assert sorted(map(tuple, BK.read(spark, root).collect())) == want and BK.versions(spark, root) == [2]


def test_a_stop_at_any_point_leaves_a_readable_table(spark, tmp_dir, monkeypatch):
    src, root, led = f"{tmp_dir}/src", f"{tmp_dir}/t", f"{tmp_dir}/ledger"
    base = spark.createDataFrame([("a", 1, 1, 1.0, 0.0, 1)], TRAINING)
    stats = spark.createDataFrame([(100.0, 10.0, 100.0)], "mean DOUBLE, std DOUBLE, var DOUBLE")
    _put(f"{src}/1.json", [_row(1, 2, "b"), _row(1, 2, None)])
    trained = []

    def run(**kw):
        return BK.update_job(spark, src, base, root, led, stats, retrain=lambda t: trained.append(t.count()), buckets=4, **kw)

    class Stop(Exception):
        pass

    def stop(*a, **k):
        raise Stop

    for module, name in ((BK, "_publish"), (FS, "record"), (BK, "compare_before_after"), (BK, "_mark_trained")):
        BK.create(spark, root, base, 4)
        if BK.trained_version(spark, root) is None:
            BK._mark_trained(spark, root, 0)
        with monkeypatch.context() as m:
            m.setattr(module, name, stop)
            with pytest.raises(Stop):
                run()
        rows = {(r["user_idx"], r["item_idx"]) for r in BK.read(spark, root).collect()}
        assert rows == ({("a", 1)} if name == "_publish" else {("a", 1), ("b", 2)}), name
    # published and noted, but never trained to the end: the next run makes up for it without a new file
    comparison, table = run()
    assert table.count() == 2 and trained == [2, 2]
    assert {r["statistic"]: r["delta"] for r in comparison.collect()}["n_records"] == 1.0
    assert run()[0] is None and trained == [2, 2]
    _put(f"{src}/2.json", [_row(5, 3, "b", "PURCHASE")])
    comparison, table = run()
    assert table.count() == 3 and trained == [2, 2, 3]
    assert spark.read.json(f"{root}/quarantine/*").where("item_id = 2").count() == 1            # the row without a user
    assert FS.file_states(FS.load_ledger(spark, led)).where("state = 'done'").count() == 2


def test_files_are_read_by_many_tasks(spark, tmp_dir):
    for i in range(16):
        _put(f"{tmp_dir}/{i}.json", [_row(i, i, "a")])
    files = L.list_files(spark, tmp_dir, ext=".json").checkpoint()
    tasks = L.read_contents(files).select(F.spark_partition_id().alias("p"), F.length("content").alias("n"))
    tasks.write.parquet(f"{tmp_dir}/tasks")
    assert spark.read.parquet(f"{tmp_dir}/tasks").select("p").distinct().count() > 4


def test_good_rows_and_bad_records_in_one_pass(spark, tmp_dir):
    _put(f"{tmp_dir}/1.json", "[" + json.dumps(_row(1, 1, "a")) + ", null, " + json.dumps(_row(2, 2, "b")) + "]")
    _put(f"{tmp_dir}/2.json", "[{not json")
    _put(f"{tmp_dir}/3.json", " \n")
    _put(f"{tmp_dir}/4.json", json.dumps(_row(3, 3, "c")) + "\n\nnot json\n")
    files = FS.list_log_files(spark, tmp_dir)
    got = lambda multiline, n: {(r["timestamp"], r[FS.CORRUPT]) for r in FS.log_records(files.where(F.col("file_path").endswith(f"{n}.json")), multiline).collect()}
    assert [got(True, n) for n in (1, 2, 3)] == [{(1, None), (2, None)}, {(None, "[{not json")}, set()]
    assert got(False, 4) == {(3, None), (None, "not json")}
    assert FS.bad_records(FS.log_records(files)).columns == ["file_path", FS.CORRUPT]


def test_batches_write_a_bounded_multiple_of_their_rows(spark, tmp_dir):
    root = f"{tmp_dir}/t"
    rows = lambda lo, hi, weight: spark.range(lo, hi).select((F.col("id") % 50).cast("string").alias("user_idx"), F.col("id").alias("item_idx"), F.lit(1).alias("label"),
                                                     F.lit(weight).alias("weight"), F.lit(0.5).alias("price_norm"), F.lit(2).alias("category_idx"))
    base = rows(0, 4000, 2.0)
    BK.create(spark, root, base, buckets=4)
    want, n = base, 8
    for i in range(n):
        new = rows(4000 + i * 100 - 20, 4100 + i * 100, 3.0).unionByName(rows(0, 20, 1.0))  # pairs of the base and of the batch before come again
        BK.merge_batch(spark, root, new, f"batch {i}")
        want = want.unionByName(new)
    want = sorted(map(tuple, P.dedup_max_weight(want).collect()))
    assert sorted(map(tuple, BK.read(spark, root).collect())) == want
    written = sum(sum(BK._written(spark, root, v).values()) for v in BK.versions(spark, root)[1:])
    assert written < 4 * 140 * n                       # every batch rewrote the table before: 8 * 4000 rows
    assert max(r["count"] for r in BK._pointer(spark, root, n).groupBy("bucket").count().collect()) <= 6
