"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to a no-op sink; the value is the sum of the median seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from billwright.plans.queries import QUERIES
from billwright.session import build_session

HEADLINE = (
    "structure_records",
    "extract_line_items",
    "extract_dates",
    "extract_amounts",
    "field_accuracy",
    "quality_report",
    "filter_confident_words",
    "page_text",
    "merge_entities",
    "entities_to_record",
    "best_ocr_variant",
    "incremental_ingest",
    "dispatch_method",
    "complete_from_rules",
    "batch_summary",
    "sink_json",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            # the test tables are single files: deal them out over the cores
            "spark.billwright.inputPartitions": str(2 * int(cpus)),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)  # warm-up
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    docs += spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    result = {
        "metric": "headline queries, sum of median seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "structure_records" in seconds:
        result["records_per_sec"] = round(docs / seconds["structure_records"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
