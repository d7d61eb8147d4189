"""Metrics of rows in an order: gaps, jumps, balances, overlapping periods, references valid at a time.

Each sorts its dataset once (``ordered``), in a job of its own, as soon as it is planned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.exact import breaks, comparable
from dqspark.functions.values import absent, field_of, how_many, named, number
from dqspark.operators.metrics import _builtin
from dqspark.operators.ordered import as_of, balances, overlaps, trailing
from dqspark.operators.scan import Frame


def _several(params: Mapping[str, Any], name: str) -> list[str]:
    given = params.get(name) or []
    return [given] if isinstance(given, str) else list(given)


def _positive(params: Mapping[str, Any], name: str) -> float:
    value = float(params[name])
    if not value > 0:
        raise ValueError(f"'{name}' must be above 0, not {params[name]}")
    return value


def _place(df: DataFrame, name: str) -> Column:
    """A moment in microseconds, counted exactly, or a number as it is."""
    kind = field_of(df, name).dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(named(name).cast("timestamp"))
    return comparable(df, name)


def _unit(df: DataFrame, name: str) -> int:
    return 1_000_000 if isinstance(field_of(df, name).dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else 1


def gaps(df: DataFrame, by: Sequence[str], order: str, longest: float) -> DataFrame:
    """Rows more than ``longest`` behind the row before them in their group, with that distance as ``gap``.

    Seconds for dates and timestamps, else the column's own unit. Rows without a place in the order are left out.
    """
    unit = _unit(df, order)
    placed = df.where(~absent(df, order))
    place = _place(df, order)
    far = trailing(placed, by, order, 1, lambda w: {"gap": place - F.lag(place, 1).over(w)}).where(F.col("gap") > longest * unit)
    return far.withColumn("gap", F.col("gap") / unit) if unit > 1 else far


@_builtin("gap_count", label="Gaps in an order", group="Order", sorts=True)
def _gap_count(df, params, datasets):
    found = gaps(df, _several(params, "by"), params["order"], _positive(params, "longest"))
    return Frame(found.agg(F.count(F.lit(1)).cast("double").alias("value"), F.max("gap").cast("double").alias("longest")))


def jumps(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, n: int, tolerance: float) -> DataFrame:
    """Rows whose value is more than ``tolerance`` from the mean of the ``n`` rows before it, as ``trailing_mean``.

    Missing values are left out of the mean and are no jump; the first row of a group has no mean.
    """
    value = number(df, column)
    found = trailing(df, by, order, n, lambda w: {"trailing_mean": F.avg(value).over(w.rowsBetween(-n, -1))})
    return found.where(F.abs(value - F.col("trailing_mean")) > tolerance)


@_builtin("jump_count", label="Jumps against earlier rows", group="Order", sorts=True)
def _jump_count(df, params, datasets):
    n = int(params.get("n", 1))
    found = jumps(df, _several(params, "by"), _several(params, "order"), params["column"], n, _positive(params, "tolerance"))
    return Frame(found.agg(F.count(F.lit(1)).cast("double").alias("value")))


@_builtin("balance_breaches", label="Running balance out of bounds", group="Order", sorts=True)
def _balance_breaches(df, params, datasets):
    lower, upper = params.get("lower"), params.get("upper")
    if lower is None and upper is None:
        raise ValueError("balance_breaches needs a lower or an upper bound")
    found = balances(df, _several(params, "by"), _several(params, "order"), params["column"], "balance")
    return Frame(found.agg(
        how_many(breaks(found, "balance", lower, upper)).cast("double").alias("value"),
        F.min("balance").cast("double").alias("least"), F.max("balance").cast("double").alias("most")))


@_builtin("overlap_count", label="Overlapping periods", group="Order", sorts=True)
def _overlap_count(df, params, datasets):
    met = overlaps(df, _several(params, "by"), params["start"], params["end"])
    pairs = F.col("n_rows").cast("decimal(38, 0)") * F.col("n_overlaps")
    return Frame(met.agg(
        F.coalesce(F.sum(F.when(F.col("n_overlaps") > 0, F.col("n_rows"))), F.lit(0)).cast("double").alias("value"),
        (F.coalesce(F.sum(pairs), F.lit(0)) / 2).cast("double").alias("pairs")))


def orphans_at(
    df: DataFrame, key: Sequence[str], at: str, ref: DataFrame, since: str, until: str | None = None, ref_key: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with a whole key whose reference is not valid at their time.

    The latest reference row that began by then counts; with ``until`` it must not have ended (it is not valid at that very
    time; null is open). A row without a time has no valid reference; one with a null in its key refers to nothing.
    """
    known = ref.select(*[named(k) for k in dict.fromkeys([*(ref_key or key), since, *([until] if until else [])])])
    whole = F.lit(True)
    for k in key:
        whole = whole & named(k).isNotNull()
    found = as_of(df.where(whole), known, key, at, since, ref_key or key, "version")
    lacking = F.col("version").isNull()
    if until:
        ended = F.col("version").getField(until)
        lacking = lacking | F.coalesce(ended <= named(at), F.lit(False))
    return found.where(lacking).drop("version")


@_builtin("orphan_count_at", label="Keys without a reference at their time", group="Integrity", sorts=True)
def _orphan_count_at(df, params, datasets):
    if params["ref"] not in datasets:
        raise KeyError(f"reference dataset '{params['ref']}' is unknown")
    key = _several(params, "column")
    rows = df.select(*[named(c) for c in dict.fromkeys([*key, params["at"]])])
    ref_key = _several(params, "ref_column") or key
    found = orphans_at(rows, key, params["at"], datasets[params["ref"]], params["ref_since"], params.get("ref_until"), ref_key)
    return Frame(found.agg(F.count(F.lit(1)).cast("double").alias("value")))
