"""What a run yields: small result tables, and lazy samples of the offending rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS_SCHEMA = (
    "suite_id string, metric_id string, type string, dataset string, column string, "
    "value double, status string, error string"
)
#: A run's metrics: with the text of values that a double may round, such as large keys, sums and moments.
EXACT_METRICS_SCHEMA = METRICS_SCHEMA + ", exact string"
TESTS_SCHEMA = (
    "suite_id string, test_id string, type string, metric_id string, dataset string, column string, "
    "value double, passed boolean, status string, message string, severity string, blocking boolean"
)
DETAILS_SCHEMA = "metric_id string, name string, value double"
INFO_SCHEMA = (
    "kind string, id string, name string, description string, comments string, export boolean, "
    "owner string, filter string, category string, control_id string"
)
INVESTIGATIONS_SCHEMA = (
    "test_id string, test_type string, description string, dataset string, "
    "total_problematic_rows bigint, sample_size bigint, sample_file string"
)


@dataclass
class SuiteResult:
    spark: SparkSession
    suite_id: str
    run_id: str
    metrics: DataFrame
    tests: DataFrame
    details: DataFrame
    info: DataFrame
    investigations: DataFrame
    samples: dict[str, DataFrame] = field(default_factory=dict)
    sampled: list[tuple[list[str], DataFrame]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    prechecks: DataFrame | None = None
    scripts: int = 0
    held: list[DataFrame] = field(default_factory=list)
    finished: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def summary(self) -> DataFrame:
        from dqspark.plans.reports import run_summary
        return run_summary(self)

    def release(self) -> None:
        """Let go of the rows of custom checks."""
        for df in self.held:
            df.unpersist()
        self.held.clear()


def consolidate(results: Sequence[tuple[str, SuiteResult]]) -> SuiteResult:
    """Several results as one, every id prefixed with its suite's name."""
    def tagged(name: str, df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.withColumn(c, F.concat(F.lit(f"{name}_"), F.col(c)))
        return df

    def united(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    head = results[0][1]
    return SuiteResult(
        spark=head.spark, suite_id="consolidated", run_id=f"consolidated_{head.run_id}",
        metrics=united([tagged(n, r.metrics, "metric_id") for n, r in results]),
        tests=united([tagged(n, r.tests, "test_id", "metric_id") for n, r in results]),
        details=united([tagged(n, r.details, "metric_id") for n, r in results]),
        info=united([tagged(n, r.info, "id") for n, r in results]),
        investigations=united([tagged(n, r.investigations, "test_id") for n, r in results]),
        samples={f"{n}_{t}": df for n, r in results for t, df in r.samples.items()},
        sampled=[([f"{n}_{t}" for t in ids], tagged(n, frame, "test_id"))
                 for n, r in results for ids, frame in r.sampled],
        tables={f"{n}_{a}": df for n, r in results for a, df in r.tables.items()},
        prechecks=united(p) if (p := [r.prechecks for _, r in results if r.prechecks is not None]) else None,
        scripts=sum(r.scripts for _, r in results), held=[df for _, r in results for df in r.held],
    )
