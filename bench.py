"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "page_meta",
    "extractability_profile",
    "link_list",
    "inbound_edges",
    "in_degree_top10",
    "orphans",
    "discoverability",
    "sections",
    "headline",
    "size_rank_percentile",
    "page_attributes",
    "scan_tree_counts",
    "page_chunks",
    "document_facts",
    "content_dedupe",
    "consistency_report",
    "site_rating",
]


def main() -> None:
    from webstrata import registry
    from webstrata.session import local_session

    spark = local_session(CPUS, int(CPUS), "8g")
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(2 if name in ("consistency_report", "site_rating") else 3):
            began = time.perf_counter()
            found[name](spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(sorted(took)[(len(took) - 1) // 2], 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))


if __name__ == "__main__":
    main()
