"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperlake.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "document_keywords", "topic_flag", "match_strategies", "phrase_match", "substring_filter",
    "date_window_items", "ordered_union_cap", "two_source_search", "title_dedup",
    "metadata_record", "atom_column", "noisy_json", "back_fill", "coverage", "attempt_select",
    "normalise", "exact_dedup", "semantic_dedup", "similarity_join", "text_semantic_dedup",
    "label_dedup", "metadata_harvest", "harvest_stream", "csv_export", "text_export",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
