"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list to override the headline set).
Each query is executed in full through the ``noop`` sink (no collect).
The split table every consumer reads is written once first and timed as
``etl_splits`` (the reference's dataset-preparation job).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "popularity_composite",      # flagship: enrich -> weight -> split -> composite top-n per category
    "project_training_columns",  # log -> training rows (weights, min-max, clip, dedup)
    "merge_new_data",            # existing train U new rows, max-weight dedup
    "random_split",              # exact seeded split via distributed global index
    "recommend_batch",           # request table -> routed hybrid / popular -> paged response
    "content_based",             # profiles + blocked cosine top-n with exclusions
    "evaluate",                  # P/R/NDCG/HitRate @5,10,20
    "negatives_per_user",        # exact-quota negative sampling
    "incremental_update",        # structured-streaming merge of new log files
]
# one grid combination with the reference's best configuration: fit ALS + FM, recommend for every
BEST_CONFIG = {"mf_factors": 30, "epochs": 30, "top_k": 250, "top_n": 50}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from marmot.plans import catalog as K
    from marmot.plans import etl as ETL
    from marmot.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="marmot-bench", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    t0 = time.time()
    ETL.splits(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["etl_splits"] = round(time.time() - t0, 3)
    for n in names:
        t = time.time()
        try:
            K.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t, 3)
        except Exception as ex:  # noqa: BLE001
            times[n] = None
            print(f"# {n} failed: {str(ex)[:300]}", file=sys.stderr)
    quality = {}
    if not os.environ.get("BENCH_QUERIES"):
        from marmot.operators import metrics as M
        from marmot.plans import train as TR
        t = time.time()
        try:
            tr, va = ETL.split_part(spark, sf_dir, "train"), ETL.split_part(spark, sf_dir, "val")
            model = TR.train_hybrid(tr, mf_factors=BEST_CONFIG["mf_factors"], als_iters=BEST_CONFIG["epochs"],
                                    ranker_iters=BEST_CONFIG["epochs"])
            ev = TR.evaluate_model(model, tr, va, BEST_CONFIG["top_k"], BEST_CONFIG["top_n"])
            quality = {k: (round(v, 5) if isinstance(v, float) else v) for k, v in M.wide(ev).first().asDict().items()}
            times["fit_evaluate_combination"] = round(time.time() - t, 3)
        except Exception as ex:  # noqa: BLE001
            times["fit_evaluate_combination"] = None
            print(f"# fit_evaluate_combination failed: {str(ex)[:300]}", file=sys.stderr)
    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus,
                      "quality_best_config": {**BEST_CONFIG, **quality}}))
    spark.stop()


if __name__ == "__main__":
    main()
