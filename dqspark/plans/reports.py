"""Report tables of a run. They are made of its result tables and never read a dataset."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.frames import local_frame
from dqspark.functions.values import how_many, quarter_label
from dqspark.plans.result import SuiteResult
from dqspark.sources.sinks import write_sample

# The columns of the two report tables.
METRICS_REPORT = (
    "ID", "Type", "Name", "Description", "Comments", "Export", "Owner", "Dataset", "Column", "Filter",
    "Execution_Status", "Value", "Error", "Timestamp")
TESTS_REPORT = (
    "quarter", "project", "run_version", "control_id", "dataset", "category", "blocking",
    "execution_status", "result", "description", "comments", "error", "user", "timestamp")

# How an execution status reads in the tests report.
RESULT_WORDS = {"SUCCESS": "PASS", "FAIL": "FAIL", "ERROR": "ERROR", "SKIPPED": "SKIPPED"}


def status_counts(result: SuiteResult) -> DataFrame:
    """Rows (kind, status, n) for metrics and tests."""
    metrics = result.metrics.select(F.lit("metric").alias("kind"), "status")
    tests = result.tests.select(F.lit("test").alias("kind"), "status")
    return metrics.unionByName(tests).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def summarize(tests: DataFrame) -> DataFrame:
    """Totals of a tests table as one row. A skipped or errored test does not pass."""
    passed = how_many(F.col("status") == "SUCCESS")
    return tests.agg(
        F.count(F.lit(1)).alias("total_tests"), passed.alias("tests_passed"),
        how_many(F.col("status") == "FAIL").alias("tests_failed"),
        how_many(F.col("status") == "ERROR").alias("tests_errored"),
        how_many(F.col("status") == "SKIPPED").alias("tests_skipped"),
        F.when(passed == F.count(F.lit(1)), "SUCCESS").otherwise("FAILED").alias("status"),
    )


def run_summary(
    result: SuiteResult, dq_id: str | None = None, quarter: str = "N/A", project: str = "N/A",
) -> DataFrame:
    """The run in one row: how much was computed, how much passed, and the verdict."""
    metrics = result.metrics.agg(
        F.count(F.lit(1)).alias("total_metrics"),
        how_many(F.col("status") == "SUCCESS").alias("metrics_computed"))
    found = result.investigations.agg(F.count(F.lit(1)).alias("investigations"))
    return (
        summarize(result.tests).withColumn("one", F.lit(1))
        .join(metrics.withColumn("one", F.lit(1)), "one").join(found.withColumn("one", F.lit(1)), "one")
        .select(
            F.lit(dq_id or result.suite_id).alias("dq_id"), F.lit(quarter).alias("quarter"),
            F.lit(project).alias("project"), F.lit(result.run_id).alias("run_id"),
            "total_metrics", "metrics_computed", "total_tests",
            F.lit(result.scripts).cast("bigint").alias("scripts_executed"),
            "tests_passed", "tests_failed", "tests_errored", "tests_skipped", "status", "investigations",
            F.when(F.col("investigations") > 0, "Yes").otherwise("No").alias("investigation_report"),
        )
    )


def metrics_report(result: SuiteResult, timestamp: str | None = None) -> DataFrame:
    """One row per metric in the 14 columns of the metrics sheet."""
    info = result.info.filter("kind = 'metric'")
    cells = (
        F.col("metric_id"), F.col("type"), _text("name"), _text("description"), _text("comments"),
        F.coalesce("export", F.lit(True)), _text("owner"), _text("dataset"), _text("column"),
        _text("filter"), F.col("status"), F.col("value"), _text("error"), _moment(result, timestamp))
    return result.metrics.join(info, F.col("metric_id") == F.col("id"), "left").select(
        *[cell.alias(name) for name, cell in zip(METRICS_REPORT, cells)])


def tests_report(result: SuiteResult, run_info: Mapping[str, Any] | None = None) -> DataFrame:
    """One row per test in the 14 columns of the tests sheet.

    ``run_info`` may give quarter, project, run_version, user and timestamp.
    """
    given = dict(run_info or {})
    moment = _moment(result, given.get("timestamp"))
    info = result.info.filter("kind = 'test'").select(
        "id", "description", "comments", "category", "control_id")
    words = F.create_map(*[F.lit(x) for pair in RESULT_WORDS.items() for x in pair])
    cells = (
        F.lit(given["quarter"]) if given.get("quarter") else quarter_label(moment),
        F.lit(given.get("project", "")),
        F.lit(given["run_version"]) if given.get("run_version") else F.date_format(moment, "yyyyMMdd_HHmmss"),
        F.coalesce("control_id", "test_id"), _text("dataset"), F.coalesce("category", F.lit("Business")),
        F.when(F.col("blocking"), "Yes").otherwise("No"), F.col("status"),
        F.coalesce(words[F.col("status")], F.lit("NOT_RUN")), _text("description"), _text("comments"),
        F.when(F.col("status") == "SUCCESS", "").otherwise(_text("message")),
        F.lit(given.get("user", "")), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    return result.tests.join(info, F.col("test_id") == F.col("id"), "left").select(
        *[cell.alias(name) for name, cell in zip(TESTS_REPORT, cells)])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _moment(result: SuiteResult, timestamp: str | None) -> Column:
    """The time given, else that of the run, so that a report reads the same each time."""
    return F.lit(result.finished) if timestamp is None else F.lit(timestamp).cast("timestamp")


def investigation_report(result: SuiteResult, folder: str | None = None, stamp: str = "") -> DataFrame:
    """Test, description, total of bad rows, sample size and, once written, the sample's file."""
    if folder is None:
        return result.investigations
    files = []
    for ids, frame in result.sampled:
        kept = frame.persist()  # one scan of the dataset, however many of its tests failed
        for test_id in ids:
            rows = kept.filter(F.col("test_id") == test_id).select("row.*")
            files.append((test_id, write_sample(rows, folder, test_id, "sample", stamp)))
        kept.unpersist()
    written = local_frame(result.spark, files, "test_id string, sample_file string")
    return result.investigations.drop("sample_file").join(written, "test_id", "left")
