"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from redline.plans.queries import REGISTRY  # noqa: E402
from redline.session import local_session  # noqa: E402
from redline.sources.derived import Corpus  # noqa: E402

HEADLINE = [
    "triage_report", "paragraph_scan", "html_block_scan", "structural_map", "paragraph_types", "readability_by_lang",
    "region_scan", "lexicon_fix", "route_counts", "gate_outcomes", "disposition_exact", "sections", "prev_next_context",
    "batch_boundaries", "terms", "patch_fanout", "review_summary", "final_render", "block_match", "locate_on_page",
    "cost_by_model", "audit_stats", "request_table", "stream_enrich",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "redline-bench")
    warm = Corpus(spark, folder)
    warm.documents.selectExpr("count(text)").collect()
    seconds = {}
    for name in names:
        started = time.time()
        REGISTRY[name][0](Corpus(spark, folder, deal=spark.sparkContext.defaultParallelism)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
