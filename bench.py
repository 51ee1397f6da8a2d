"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Every query runs once to warm up and then ``BENCH_RUNS`` times (default 3); the median counts.
Results are written to a no-op sink, so that whole results are produced and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewmill.catalog.queries import QUERIES
from reviewmill.session import build_session

HEADLINE = [
    "ts_compare",
    "ts_ratings_month",
    "report_rating_share",
    "report_category_stars",
    "report_company_stars_pct",
    "company_star_bars",
    "filter_in_any",
    "review_search",
    "review_company_join",
    "knn_reviews",
    "knn_single",
    "knn_all_vectors",
    "nearest_company",
    "representative_sample",
    "weighted_sample",
    "review_payload",
    "token_count",
    "upsert_reviews",
    "changed_reviews",
    "extract_reviews",
    "page_links",
    "last_messages",
    "mention_extract",
    "plan_steps",
    "sql_top_company",
    "stream_ratings_day",
    "stream_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "reviewmill-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
