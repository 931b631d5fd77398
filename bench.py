"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose data and
cores. Every query runs over its whole tables into a sink that keeps nothing.

The given tables are one file with one row group each, which Spark can only scan in one task. Tables
of the size this is built for lie in many files; so the same rows are first written as one file per
core, which is not timed, and the plans that run are those of large tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "extract_main_text",
    "extract_listings",
    "exclude_with_reason",
    "suitability_cascade",
    "extract_skills",
    "dedup_keep_latest",
    "anti_known_hash",
    "upsert_longest",
    "status_updates",
    "rank_by_score",
    "score_distribution",
    "tfidf_cosine",
    "score_chain",
    "variant_scores",
    "select_items",
    "incremental_scan",
]


def in_many_files(spark, folder: str, files: int) -> str:
    out = tempfile.mkdtemp(prefix="spark-")
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".parquet")):
        spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

    from gleaner.plans.catalog import QUERIES
    from gleaner.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the session is not part of any query
    spark.range(1000).selectExpr("sum(id)").collect()
    only = sys.argv[1:]
    tables = in_many_files(spark, folder, int(cpus))
    seconds = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)),
                "cpus": int(cpus),
                "files_per_table": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
