"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, or "all"), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from visilake.registry import registered
from visilake.session import local_session, ship_package

HEADLINE = (
    "rank_median", "rank_latest_delta", "rank_movers", "record_positions", "competition_score", "serp_competitors", "top_domains",
    "domain_queries", "competitor_gap", "merge_serp_pages", "latest_window", "window_totals", "upsert_window", "query_ctr", "goal_funnel",
    "weighted_position", "stem_dedup", "classify_phrase", "collect_core", "sync_pool", "text_keys", "url_keys", "article_report",
    "content_gaps", "page_facts", "incoming_links", "page_rules", "duplicate_titles", "bot_access", "llms_txt_findings", "ai_answers",
    "ai_citations", "citation_share", "quick_wins", "cannibalization_actions", "gap_actions", "plan_ranked",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    known = registered()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus=cpus)
    ship_package(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
