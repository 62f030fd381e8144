"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.compare import session
from checks.queries import QUERIES

HEADLINE = [
    "decode_repo",
    "section_queries",
    "embed_hash",
    "embed_two_models",
    "index_roundtrip",
    "knn_topk",
    "knn_topk_block",
    "knn_full_rank",
    "knn_lsh",
    "search_listing",
    "prompt_table",
    "doc_context",
    "match_single",
    "match_dual",
    "accuracy_by_model",
    "confusion_metrics",
    "stream_match",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    # Start the Python workers and load the classes before the clock runs.
    QUERIES["search_listing"](spark, sf).count()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
