"""Checks of suite specifications held as tables, for catalogs of many suites."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.functions.frames import local_frame
from dqspark.functions.values import how_many
from dqspark.plans.definition import suite_items


def check_ids(suites: DataFrame) -> DataFrame:
    """Ids used more than once in a suite: rows (suite_id, id, problem, n).

    ``suites`` has (suite_id, kind, id), with kind metric or test. Both an id repeated within one
    kind and an id shared by a metric and a test are reported. Counting the kinds conditionally
    keeps it to one shuffle that is summed in part before it, so a hot id costs nothing extra.
    """
    counted = suites.groupBy("suite_id", "id").agg(
        how_many(F.col("kind") == "metric").alias("metrics"),
        how_many(F.col("kind") == "test").alias("tests"))
    problems = F.array_compact(F.array(
        F.when(F.col("metrics") > 1, F.struct(F.lit("duplicate metric").alias("problem"), F.col("metrics").alias("n"))),
        F.when(F.col("tests") > 1, F.struct(F.lit("duplicate test").alias("problem"), F.col("tests").alias("n"))),
        F.when((F.col("metrics") > 0) & (F.col("tests") > 0),
               F.struct(F.lit("metric and test").alias("problem"), (F.col("metrics") + F.col("tests")).alias("n"))),
    ))
    return counted.select("suite_id", "id", F.inline(problems))


_REFERENCE = ["problem", "within", "name"]


def check_refs(tests: DataFrame, metrics: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tests that name an unknown metric, dataset or column: rows (suite_id, test_id, problem, reference).

    ``tests`` has (suite_id, test_id, metric_id, dataset, column), ``metrics`` (suite_id,
    metric_id) and ``datasets`` (dataset, column). A column is only looked for in a known dataset.
    The references of a test are found in one pass, and each distinct one is looked up once. The bad
    ones are few against the tests, so Spark broadcasts them by its own size check; where it cannot,
    it splits references that many tests share at run time.
    """
    def entry(problem: str, within: str, name: str, there: str) -> str:
        return f"if({there}, named_struct('problem', '{problem}', 'within', {within}, 'name', {name}), null)"

    on_data = "metric_id is null and dataset is not null"
    references = tests.selectExpr("suite_id", "test_id", "inline(array_compact(array(" + ", ".join([
        entry("unknown metric", "cast(suite_id as string)", "metric_id", "metric_id is not null"),
        entry("unknown dataset", "''", "dataset", on_data),
        entry("unknown column", "dataset", "column", f"{on_data} and column is not null")]) + ")))")
    known = metrics.selectExpr("'unknown metric' as problem", "cast(suite_id as string) as within", "metric_id as name").unionByName(
        datasets.selectExpr("inline(array(" + ", ".join([
            "named_struct('problem', 'unknown dataset', 'within', '', 'name', dataset)",
            "named_struct('problem', 'unknown column', 'within', dataset, 'name', column)"]) + "))")).distinct()
    unknown = references.select(*_REFERENCE).distinct().join(known, _REFERENCE, "left_anti")
    there = datasets.select(F.col("dataset").alias("within"), F.lit(True).alias("there")).distinct()
    bad = unknown.join(there, "within", "left").filter("problem <> 'unknown column' or there").select(*_REFERENCE)
    return references.join(bad, _REFERENCE, "left_semi").selectExpr(
        "suite_id", "test_id", "problem",
        "if(problem = 'unknown column', concat(within, '.', name), name) as reference")


def spec_tables(
    spark: SparkSession, suite: Mapping[str, Any], datasets: Mapping[str, DataFrame],
) -> dict[str, DataFrame]:
    """One suite as the tables the checks above read: ids, tests, metrics and datasets."""
    name = suite.get("id") or "suite"
    metrics, tests = suite_items(suite)
    ids = [(name, "metric", m["id"]) for m in metrics] + [(name, "test", t["id"]) for t in tests]
    references = []
    for t in tests:
        columns = t.get("columns") or t.get("column") or [None]
        metric = t.get("metric_id") or t.get("metric") or t.get("associated_metric_id")
        for c in [columns] if isinstance(columns, str) else columns:
            references.append((name, t["id"], metric, t.get("dataset"), c))
    known = [(alias, c) for alias in datasets for c in datasets[alias].columns]
    return {
        "ids": local_frame(spark, ids, "suite_id string, kind string, id string"),
        "tests": local_frame(spark, references, "suite_id string, test_id string, metric_id string, "
                             "dataset string, column string"),
        "metrics": local_frame(spark, [(name, m["id"]) for m in metrics], "suite_id string, metric_id string"),
        "datasets": local_frame(spark, known, "dataset string, column string"),
    }


def validate_suite(
    spark: SparkSession, suite: Mapping[str, Any], datasets: Mapping[str, DataFrame],
) -> DataFrame:
    """What is wrong with a suite before it runs: rows (id, problem, reference)."""
    tables = spec_tables(spark, suite, datasets)
    return check_ids(tables["ids"]).select("id", "problem", F.lit(None).cast("string").alias("reference")).unionByName(
        check_refs(tables["tests"], tables["metrics"], tables["datasets"])
        .select(F.col("test_id").alias("id"), "problem", "reference"))
