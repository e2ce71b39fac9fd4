"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON with seconds a query."""

from __future__ import annotations

import json
import os
import statistics
import time

from kgaudit.plans import catalogue
from kgaudit.session import build_session

HEADLINE = ("audit_verdict", "rule_features_long", "gate_trace", "temporal_summary", "query_edge", "ego_1hop", "node_degrees", "reified_support_ratio", "route_assoc_direct", "edge_labels", "upsert_last_wins", "sentence_split", "nli_paper_top3", "prototype_classify", "auroc_auprc")
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):  # the first one warms up
            began = time.perf_counter()
            catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "audit headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
