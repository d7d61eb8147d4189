"""Deliveries of files by other teams, and the inventory of datasets and definitions, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.frames import first_rows
from dqspark.functions.values import how_many
from dqspark.operators.skew import salted_join

# The states of a submission.
STATUSES = ("pending", "processing", "dq_success", "dq_failed", "rejected", "error")


def missing_files(spec: DataFrame, submissions: DataFrame, delivered: DataFrame) -> DataFrame:
    """Required files a submission lacks: rows (submission_id, channel_id, file_id, name).

    ``spec`` has (channel_id, file_id, name, required), ``submissions`` (submission_id,
    channel_id) and ``delivered`` (submission_id, file_id). A busy channel is spread when it meets
    its files; the anti join that follows is on (submission, file), which no channel can make hot.
    """
    required = spec.filter("required").select("channel_id", "file_id", "name")
    expected = salted_join(
        submissions.select("submission_id", "channel_id"), required, ["channel_id"], "inner", ["submission_id"])
    there = delivered.select("submission_id", "file_id").distinct()
    return expected.join(there, ["submission_id", "file_id"], "left_anti").select(
        "submission_id", "channel_id", "file_id", "name")


def filename_check(delivered: DataFrame, spec: DataFrame) -> DataFrame:
    """Whether each delivered file's name fits its specification's pattern.

    ``delivered`` has (submission_id, channel_id, file_id, file_name), ``spec`` (channel_id,
    file_id, pattern). No pattern accepts every name; a file no specification knows is refused.
    """
    patterns = spec.select("channel_id", "file_id", "pattern", F.lit(True).alias("known"))
    joined = salted_join(delivered, patterns, ["channel_id", "file_id"], "left", ["submission_id", "file_name"])
    matches = F.coalesce(F.regexp_like(F.col("file_name"), F.col("pattern")), F.lit(True))
    known = F.coalesce("known", F.lit(False))
    return joined.select(
        "submission_id", "channel_id", "file_id", "file_name", (known & matches).alias("passed"),
        F.when(~known, "no specification").when(matches, "OK").otherwise("name does not match").alias("message"),
    )


def verdict(tests: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Accept or reject each submission from the statuses of its tests.

    Any error gives ERROR, any failure REJECTED, any skip DQ_FAILED, otherwise DQ_SUCCESS;
    ``overrides`` lists the submission_ids accepted by hand.
    """
    counts = tests.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("dq_total"),
        how_many(F.col("status") == "SUCCESS").alias("dq_passed"),
        how_many(F.col("status") == "FAIL").alias("dq_failed"),
        how_many(F.col("status") == "SKIPPED").alias("dq_skipped"),
        how_many(F.col("status") == "ERROR").alias("dq_errors"),
    )
    decided = (
        F.when(F.col("dq_errors") > 0, "ERROR").when(F.col("dq_failed") > 0, "REJECTED")
        .when(F.col("dq_skipped") > 0, "DQ_FAILED").otherwise("DQ_SUCCESS"))
    if overrides is None:
        return counts.withColumn("verdict", decided).withColumn("accepted", F.col("verdict") == "DQ_SUCCESS")
    by_hand = overrides.select("submission_id").distinct().withColumn("by_hand", F.lit(True))
    return (
        counts.join(by_hand, "submission_id", "left").withColumn("verdict", decided)
        .withColumn("accepted", (F.col("verdict") == "DQ_SUCCESS") | F.coalesce("by_hand", F.lit(False)))
        .drop("by_hand"))


def channel_stats(submissions: DataFrame) -> DataFrame:
    """Submissions per channel and status, and the success rate in percent."""
    total = F.count(F.lit(1))
    return submissions.groupBy("channel_id").agg(
        total.alias("total_submissions"),
        *[how_many(F.col("status") == s).alias(s) for s in STATUSES],
        (how_many(F.col("status") == "dq_success").cast("double") / total * F.lit(100.0)).alias("success_rate"),
    )


def recent(submissions: DataFrame, channel: str | None = None, n: int = 100) -> DataFrame:
    """The latest submissions, of one channel or of all; ties go to the smaller id."""
    rows = submissions if channel is None else submissions.filter(F.col("channel_id") == F.lit(channel))
    return first_rows(rows, [F.col("submitted_at").desc(), F.col("submission_id")], n)


# --- inventory

def flatten_inventory(inventory: DataFrame) -> DataFrame:
    """One row per dataset from rows of streams (id, projects: [(id, zones: [(id, datasets)])]).

    A zone without datasets stays, with '-' for its dataset and alias.
    """
    projects = inventory.select(F.col("id").alias("stream"), F.explode("projects").alias("p"))
    zones = projects.select("stream", F.col("p.id").alias("project"), F.explode("p.zones").alias("z"))
    datasets = zones.select(
        "stream", "project", F.col("z.id").alias("zone"), F.explode_outer("z.datasets").alias("d"))

    def known(field: str) -> Column:
        return F.when(F.col("d").isNull(), "-").otherwise(F.coalesce(F.col(f"d.{field}"), F.lit("")))
    return datasets.select(
        "stream", "project", "zone", known("name").alias("dataset"), known("alias").alias("alias"),
        F.when(F.col("d").isNull(), F.lit(None)).otherwise(F.col("d.path")).alias("source"))


def zone_counts(flat: DataFrame) -> DataFrame:
    """Datasets per zone of a flattened inventory, zones without any included."""
    return flat.groupBy("stream", "project", "zone").agg(
        how_many(F.col("dataset") != "-").alias("datasets_count"))


# --- definitions

def search_definitions(defs: DataFrame, quarter: str | None = None, text: str | None = None) -> DataFrame:
    """Definitions of a quarter whose id, label, stream or project holds the text, in any case."""
    if quarter and quarter != "all":
        defs = defs.filter(F.col("quarter") == F.lit(quarter))
    if text:
        needle = F.lit(text.lower())
        hit = F.lit(False)
        for c in ("id", "label", "stream", "project"):
            hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
        defs = defs.filter(hit)
    return defs


def definition_stats(defs: DataFrame, quarter: str | None = None, text: str | None = None) -> DataFrame:
    """Totals of definitions, metrics, tests and distinct datasets, as one row.

    ``defs`` has (id, label, stream, project, zone, quarter, datasets: array, metrics_count,
    tests_count).
    """
    chosen = search_definitions(defs, quarter, text)
    totals = chosen.agg(
        F.count(F.lit(1)).alias("total_definitions"),
        F.coalesce(F.sum("metrics_count"), F.lit(0)).cast("bigint").alias("total_metrics"),
        F.coalesce(F.sum("tests_count"), F.lit(0)).cast("bigint").alias("total_tests"))
    datasets = chosen.select(F.explode("datasets").alias("d")).distinct().agg(
        F.count(F.lit(1)).alias("total_datasets"))
    return totals.withColumn("one", F.lit(1)).join(datasets.withColumn("one", F.lit(1)), "one").drop("one")


def definition_values(
    defs: DataFrame, quarter: str | None = None, text: str | None = None,
    fields: Sequence[str] = ("stream", "project", "zone", "quarter"),
) -> DataFrame:
    """The distinct streams, projects, zones and quarters as rows (field, value, definitions).

    Rows rather than lists in one row, so that no catalog is too large for it.
    """
    chosen = search_definitions(defs, quarter, text)
    pairs = chosen.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])))
    return pairs.filter("value is not null and value <> 'N/A'").groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("definitions"))
