"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from kbspark import catalog
from kbspark.session import local_session

HEADLINES = (
    "chunk_text", "kb_text_sanitize", "mask_pii_strict", "email_thread_clean", "scan_pages_to_chunks",
    "dedupe_exact", "dedupe_substring", "dedupe_semantic", "kb_build", "kb_ingest_with_rejects",
    "knn_topk", "retrieve_batch", "ticket_triage", "escalation_decision",
    "usage_and_alerts", "cap_autoblock", "quota_counters",
    "rate_limit_sliding_log", "ip_abuse_sliding_log", "request_admission_replay",
    "interaction_lookup", "interaction_audit", "classification_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).write.format("noop").mode("overwrite").save()
    known, times = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
