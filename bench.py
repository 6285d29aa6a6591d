"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from netprism.queries import QUERIES
from netprism.session import local_session, release

HEADLINE = [
    "extract_interfaces", "extract_acl_rules", "extract_mac_table", "text_redaction", "text_top_keywords", "text_entities_documents", "wireless_client_matrix", "wireless_event_correlation",
    "wireless_anomalies", "wireless_client_state", "stream_daily_alerts", "audit_login_window", "audit_chain_summary", "graph_degrees", "graph_components",
    "merge_enrich_by_key", "findings_duplicate_ips", "policy_diff", "tree_nodes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    seconds = {}
    for name in names:
        release()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
