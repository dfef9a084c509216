"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is forced with the ``noop`` sink (full execution, nothing pulled
to the driver), once to warm up and then timed as the median of
$BENCH_RUNS runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry import registry  # noqa: E402
from quarry.session import get_spark  # noqa: E402

HEADLINE = [
    "grep_lines", "top_matches_per_file", "grep_context", "parse_actions", "qa_pairs", "match_tool_results",
    "evaluation_report", "evaluate_traces", "match_sample", "fill_merged_cells", "flatten_banner_rows",
    "tfidf_search", "topk_similarity", "topk_batch", "maxsim_search", "chunk_blocks", "stream_tool_health",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="quarry-bench",
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    out = {}
    for n in names:
        df = qs[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # warm-up (codegen, file listing)
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[n](spark, sf).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        out[n] = round(statistics.median(ts), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
