"""Checks of the user's own: Python functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

# When a check may run, relative to the suite's own metrics and tests.
PHASES = ("pre_dq", "post_dq", "independent")

CHECK_COLUMNS = {
    "id": T.StringType(), "value": T.DoubleType(), "passed": T.BooleanType(), "message": T.StringType(),
}

CHECKS: dict[str, Callable[[CheckContext, dict[str, Any]], DataFrame]] = {}


@dataclass(frozen=True)
class CheckContext:
    """What a check may use: the datasets and, after the suite's metrics ran, their values."""
    spark: SparkSession
    datasets: Mapping[str, DataFrame]
    metrics: Mapping[str, float | None] = field(default_factory=dict)

    def load(self, alias: str) -> DataFrame:
        return self.datasets[alias]


def check(name: str):
    """Register ``fn(context, params)`` that returns rows (id, value, passed, message).

    A row with a null ``passed`` is a measurement rather than a verdict.
    """
    def register(fn):
        CHECKS[name] = fn
        return fn
    return register


def run_check(name: str, context: CheckContext, params: Mapping[str, Any] | None = None) -> DataFrame:
    """The check's rows, with its output columns checked and cast; raises on a wrong shape."""
    if name not in CHECKS:
        raise KeyError(f"custom check '{name}' is not registered")
    made = CHECKS[name](context, dict(params or {}))
    if not isinstance(made, DataFrame):
        raise TypeError(f"custom check '{name}' must return a DataFrame")
    missing = [c for c in CHECK_COLUMNS if c not in made.columns]
    if missing:
        raise ValueError(f"custom check '{name}' lacks the columns {missing}")
    return made.select(*[made[c].cast(t).alias(c) for c, t in CHECK_COLUMNS.items()])
