"""Headline queries, timed one by one: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veritrail.plans import catalog
from veritrail.session import local_session

HEADLINE = ["check", "rules_core", "compound", "graph_core", "sh_1", "oos_goals", "ag_3", "ag_8", "ag_13", "ag_35", "j_1", "fp_3", "w_prov_01", "jd_1", "wn_8", "cr_1", "tx_6", "tx_11", "ma_7"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/veritrail-bench")
    catalog.QUERIES["ag_1"](spark, sf_dir).count()  # start-up doesn't count
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
