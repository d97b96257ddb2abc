"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cloakframe.plans import QUERIES  # noqa: E402
from cloakframe.session import local_session  # noqa: E402

ROUNDS = 3  # timed runs of a query; the middle one counts
HEADLINE = [
    "scan_patterns", "resolve_overlaps", "tokenize_documents", "tokenize_messages", "run_statistics",
    "resolve_under_grants", "disclosure_audit", "vault_upsert", "vault_sessions", "word_spans", "exact_split",
    "rendered_turns", "cosine_top_k", "approximate_top_k", "rate_windows", "recent_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # compiles code; not timed
        runs = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
