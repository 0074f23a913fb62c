"""Print scale red flags in the physical plan of every registered query.

usage: python tools/plan_audit.py [--sf DIR] [name ...]
Flags: nested-loop / cartesian joins, single-partition exchanges (global
windows or sorts), and per-query counts of exchanges and scans.
"""
import argparse
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from marmot.plans import catalog as K
    from marmot.session import get_spark
    spark = get_spark("local[4]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    for n in a.names or list(K.QUERIES):
        try:
            df = K.QUERIES[n](spark, a.sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception as ex:  # noqa: BLE001
            print(f"{n}: ERROR {str(ex)[:200]}")
            continue
        flags = []
        for pat in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "TakeOrderedAndProject"):
            c = len(re.findall(pat, plan))
            if c:
                flags.append(f"{pat}x{c}")
        ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan))
        bc = len(re.findall(r"BroadcastExchange", plan))
        print(f"{n}: shuffles={ex} broadcasts={bc} {' '.join(flags)}")
    spark.stop()


if __name__ == "__main__":
    main()
