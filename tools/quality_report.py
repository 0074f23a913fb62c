"""Offline quality of the hybrid on the given tables with the reference's best configuration.

usage: python tools/quality_report.py [SF_DIR] [ranker]
Prints one JSON line with Precision/Recall/NDCG/HitRate @5,10,20 on the val split.
"""
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ranker = sys.argv[2] if len(sys.argv) > 2 else "fm"
    from marmot.operators import metrics as M
    from marmot.plans import etl as ETL
    from marmot.plans import train as TR
    from marmot.session import get_spark
    spark = get_spark("local[8]", app="marmot-quality", shuffle_partitions=16,
                      extra={"spark.ui.showConsoleProgress": "false"})
    t0 = time.time()
    tr, va = ETL.split_part(spark, sf, "train"), ETL.split_part(spark, sf, "val")
    model = TR.train_hybrid(tr, mf_factors=30, als_iters=30, ranker_iters=30, ranker=ranker)
    t_fit = time.time() - t0
    ev = TR.evaluate_model(model, tr, va, top_k=250, top_n=50)
    w = M.wide(ev).first().asDict()
    print(json.dumps({"sf": sf, "ranker": ranker, "fit_sec": round(t_fit, 1),
                      "fit_eval_sec": round(time.time() - t0, 1), **{k: (round(v, 5) if isinstance(v, float) else v)
                                                                   for k, v in w.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
