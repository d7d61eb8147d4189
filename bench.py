"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores. Each query runs once to warm up
and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import examples  # noqa: E402
from dqspark import compute_metrics  # noqa: E402
from dqspark.operators import (  # noqa: E402
    Metric, duplicate_total, interval_check_columns, investigate_duplicates, orphan_count,
)
from examples.metrics import BATCH  # noqa: E402
from examples.tables import table  # noqa: E402

NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax")


def batch_one_by_one(spark, sf):
    """The twenty metrics of ``metric_batch`` as twenty jobs: what sharing scans saves."""
    df = table(spark, sf, "lineitem")
    for m in BATCH:
        compute_metrics(df, [m]).collect()
    return None


def interval_check_all_numeric(spark, sf):
    return interval_check_columns(table(spark, sf, "lineitem"), NUMERIC, 0, 100_000)


def orphan_lines(spark, sf):
    return orphan_count(table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders"), "o_orderkey")


def duplicate_samples(spark, sf):
    documents = table(spark, sf, "documents")
    duplicate_total(documents, "text", digest=True).collect()
    return investigate_duplicates(documents, "text", "doc_id", 100, digest=True)


def all_columns_missing(spark, sf):
    return compute_metrics(table(spark, sf, "lineitem"), [Metric("missing_rate", id="all")])


QUERIES = {
    "metric_batch_20": examples.metrics.metric_batch,
    "missing_rate_all_columns": all_columns_missing,
    "interval_check_all_numeric": interval_check_all_numeric,
    "duplicate_count_text": examples.metrics.duplicate_count,
    "investigate_duplicates_text": duplicate_samples,
    "orphan_count_lineitem_orders": orphan_lines,
    "aggregation_by_column": examples.metrics.aggregation_by_column,
    "unique_count": examples.metrics.unique_count,
    "run_suite": examples.suites.suite,
    "investigation_report": examples.suites.report_of_investigations,
    "submission_verdict": examples.deliveries.submission_verdict,
    "channel_stats": examples.deliveries.channel_statistics,
}

# Timed for comparison only; not part of the total.
COMPARED = {"metric_batch_20_one_by_one": batch_one_by_one}


def seconds(fn, spark, sf) -> float:
    start = time.perf_counter()
    df = fn(spark, sf)
    if isinstance(df, DataFrame):
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("dqspark bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    timings, cold = {}, {}
    for name, fn in {**QUERIES, **COMPARED}.items():
        cold[name] = round(seconds(fn, spark, sf), 3)
        timings[name] = round(statistics.median(seconds(fn, spark, sf) for _ in range(3)), 3)
    compared = {name: timings.pop(name) for name in COMPARED}
    print(json.dumps({
        "metric": "total_seconds_median_warm", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "compared": compared, "cold": cold, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
