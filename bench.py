"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from rankloom.session import build_session
from rankloom.workload import catalog

HEADLINES = [
    "gap_top_keywords",
    "rank_check",
    "category_counts",
    "competitor_panels",
    "suggested_competitors",
    "difficulty",
    "monthly_demand",
    "keyword_clusters",
    "serp_overlap",
    "top_pages",
    "snapshot_totals",
    "competitor_cascade",
    "page_sample",
    "page_features",
    "ngrams",
    "topic_counts",
    "evidence_union",
    "running_cost",
    "demand_stream",
    "topic_coverage",
    "discovery_picked",
    "chosen_phrases",
    "page_phrases_mmr",
    "nearest_vectors",
]
LATE = "gap_top_keywords"  # timed once more at the end, when code is compiled


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "rankloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["monthly_demand"](spark, folder).count()  # start-up is not a query
    times: dict[str, float] = {}

    def timed(name: str) -> float:
        spark.catalog.clearCache()  # every query pays for its own inputs
        start = time.perf_counter()
        rows = catalog.QUERIES[name](spark, folder)
        rows.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINES:
        times[name] = timed(name)
    again = timed(LATE)
    keywords = spark.read.parquet(f"{folder}/part.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                f"{LATE}_again": again,
                "keywords": keywords,
                "keywords_per_sec": round(keywords / times["gap_top_keywords"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
