"""Metrics kept as states that add up, so that a delivery costs only the scan of its own rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqspark.functions.predicates import DISTINCT, QUANTILE, SKETCH_SIZE, Scope, sketched_quantile
from dqspark.functions.values import how_many, named
from dqspark.operators.metrics import Metric, build_probe
from dqspark.operators.scan import Probe, Scan, answer_cells
from dqspark.sources.sinks import replace_part

# How the parts of a state are put together.
MERGE = {
    "sum": F.sum, "min": F.min, "max": F.max, "hll": F.hll_union_agg, "theta": F.theta_union_agg,
    "bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double,
}


class Parts(Scope):
    """A scope that takes a metric's aggregates apart: each becomes a column of its state, and what the metric
    makes of them is an expression over these columns, the same for one part and for many put together."""

    def __init__(self, keep: Column | None, prefix: str):
        super().__init__(keep)
        self.prefix = prefix
        self.columns: dict[str, tuple[str, Column]] = {}

    def _part(self, how: str, aggregate: Column) -> Column:
        name = f"{self.prefix}_{len(self.columns)}"
        self.columns[name] = (how, aggregate)
        return F.col(name)

    def rows(self) -> Column:
        return self._part("sum", super().rows())

    def count_if(self, condition: Column) -> Column:
        return self._part("sum", super().count_if(condition))

    def total(self, value: Column) -> Column:
        return self._part("sum", super().total(value))

    def least(self, value: Column) -> Column:
        return self._part("min", super().least(value))

    def most(self, value: Column) -> Column:
        return self._part("max", super().most(value))

    def mean(self, value: Column) -> Column:
        n, total = self._part("sum", how_many(self.only(value).isNotNull())), self.total(value)
        return F.when(n > 0, total / n)

    def deviation(self, value: Column) -> Column:
        own = self.only(value)
        n, mean = how_many(own.isNotNull()), F.avg(own)
        parts = [self._part("sum", x) for x in (n, F.sum(own), F.var_pop(own) * n, mean * mean * n)]
        spread = parts[2] + parts[3] - parts[1] * parts[1] / parts[0]
        return F.when(parts[0] > 1, F.sqrt(F.greatest(F.lit(0.0), spread) / (parts[0] - 1)))

    def distinct(self, value: Column, sketch: str | None = None) -> Column:
        build, estimate = DISTINCT[sketch or "hll"]
        return estimate(self._part(sketch or "hll", build(self.only(value))))

    def quantile(self, value: Column, rank: float, kind: str) -> Column:
        return sketched_quantile(self._part(kind, QUANTILE[kind][0](self.only(value), F.lit(SKETCH_SIZE))), rank, kind)


def state_parts(df: DataFrame, metrics: Sequence[Metric]) -> list[tuple[Metric, Parts, Column]]:
    """The state columns of each metric and its value over them; a changed metric has other columns."""
    out = []
    for m in metrics:
        made = build_probe(m, df, {}, "")
        if not isinstance(made, Probe) or not isinstance(made.ask, Scan):
            raise ValueError(f"metric '{m.id}' of type '{m.type}' has no state that adds up")
        if m.type in ("unique_count", "nunique") and not m.params.get("sketch"):
            raise ValueError(f"metric '{m.id}' needs a sketch, hll or theta, to add up")
        definition = json.dumps([m.type, m.params], sort_keys=True, default=str)
        scope = Parts(made.keep, "s" + hashlib.sha256(definition.encode()).hexdigest()[:16])
        out.append((m, scope, made.ask.build(scope)[made.ask.value]))
    return out


def metric_states(df: DataFrame, metrics: Sequence[Metric], labels: Mapping[str, Any] | None = None) -> DataFrame:
    """The states of metrics over a frame as one row, in one scan: binary sketches, counts, sums, extremes.

    ``labels`` are columns to tell the row by, such as channel and day.
    """
    columns, seen = [], set()
    for _, scope, _ in state_parts(df, metrics):
        if scope.prefix not in seen:
            columns += [column.alias(name) for name, (_, column) in scope.columns.items()]
            columns.append(F.count(F.lit(1)).alias(f"{scope.prefix}_rows"))
            seen.add(scope.prefix)
    return df.agg(*columns).select(*[F.lit(v).alias(k) for k, v in (labels or {}).items()], "*")


def merge_states(states: DataFrame, metrics: Sequence[Metric], like: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over all rows behind some states: (``by``, metric_id, value, exact, parts, rows).

    Counts, extremes and sums of integers and decimals are those of one scan, bit for bit; sums of doubles
    but for rounding; sketches within their error, as if one had seen all rows. ``parts`` and ``rows`` tell
    how many states, of how many rows, held the metric: one that was added later is missing from earlier
    ones. ``like`` has the columns and types of the rows, but need not hold any.
    """
    parts = [p for p in state_parts(like, metrics) if f"{p[1].prefix}_rows" in states.columns]
    merged = {}
    for _, scope, _ in parts:
        held = F.col(f"{scope.prefix}_rows")
        merged |= {name: MERGE[how](name).alias(name) for name, (how, _) in scope.columns.items()}
        merged[f"{scope.prefix}_parts"] = F.count(held).alias(f"{scope.prefix}_parts")
        merged[f"{scope.prefix}_rows"] = F.sum(held).alias(f"{scope.prefix}_rows")
    if not parts:
        raise ValueError("these states hold none of the metrics")
    together = states.groupBy(*[named(b) for b in by]).agg(*merged.values())
    values = together.select(
        *[named(b) for b in by], *[v.alias(f"v{i}") for i, (_, _, v) in enumerate(parts)],
        *[F.struct(F.col(f"{s.prefix}_parts").alias("parts"), F.col(f"{s.prefix}_rows").alias("rows")).alias(f"h{i}") for i, (_, s, _) in enumerate(parts)])
    cells = answer_cells(values, [(f"v{i}", {"metric_id": m.id}) for i, (m, _, _) in enumerate(parts)])
    held = F.array(*[F.col(f"h{i}") for i in range(len(parts))])
    return values.select(*[named(b) for b in by], F.explode(F.arrays_zip(cells.alias("answer"), held.alias("held"))).alias("x")).select(
        *[named(b) for b in by], "x.answer.*", "x.held.*")


def store_states(df: DataFrame, metrics: Sequence[Metric], path: str, part: str, labels: Mapping[str, Any] | None = None) -> None:
    """Keep the states of one delivery's rows in a table; the same part again replaces its row."""
    replace_part(metric_states(df, metrics, labels), path, "part", part)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all parts; columns of metrics that some parts lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def shared_keys(states: DataFrame, metric: Metric, like: DataFrame, by: str) -> DataFrame:
    """About how many distinct keys each two neighbouring groups of states have in common: (``by``, before, shared).

    ``metric`` is a ``unique_count`` with a theta sketch; groups are ordered by ``by``.
    """
    ((_, scope, _),) = state_parts(like, [metric])
    (name,) = [n for n, (how, _) in scope.columns.items() if how == "theta"]
    order = Window.partitionBy(F.lit(0)).orderBy(by)  # one row a group of states
    grouped = states.groupBy(named(by)).agg(F.theta_union_agg(name).alias("keys"))
    return grouped.select(
        named(by), F.lag(named(by)).over(order).alias("before"),
        F.theta_sketch_estimate(F.theta_intersection("keys", F.lag("keys").over(order))).alias("shared"))
