"""Data quality over Spark tables: metrics, tests, suites, samples and deliveries as DataFrames."""

from dqspark.operators import Metric, check, compute_metrics, metric  # noqa: F401
from dqspark.plans import SuiteResult, consolidate, run_suite, run_suites  # noqa: F401
from dqspark.sources import DatasetRegistry, load  # noqa: F401
