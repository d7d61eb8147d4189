"""Metrics at every level of some keys at once: rollups, cubes and sets of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dqspark.functions.values import named
from dqspark.operators.metrics import Metric
from dqspark.operators.scan import answer_cells
from dqspark.operators.state import MERGE, state_parts


def metric_levels(
    df: DataFrame, metrics: Sequence[Metric], by: Sequence[str], levels: str | Sequence[Sequence[str]] = "rollup",
) -> DataFrame:
    """Metrics for groups of several keys and for their totals: (``by``, level, metric_id, value, exact).

    ``levels`` is ``rollup`` (totals from the last key on), ``cube`` (all combinations) or a list of the sets of
    keys wanted. ``level`` is the grouping id: the bit of a key that a row sums over is set, the last key's is 1,
    which tells such a total from the group of a null key.

    The rows are read and shuffled once, as states of the finest groups that were summed before the shuffle; every
    level is put together from these states, so its cost goes with the number of groups. A metric needs a state
    that adds up, as in ``metric_states``.
    """
    parts = state_parts(df, metrics)
    keys = [named(b) for b in by]
    columns, together = {}, {}
    for _, scope, _ in parts:
        for name, (how, column) in scope.columns.items():
            columns[name] = column.alias(name)
            together[name] = MERGE[how](name).alias(name)
    states = df.groupBy(*keys).agg(*columns.values())
    if levels == "rollup":
        grouped = states.rollup(*keys)
    elif levels == "cube":
        grouped = states.cube(*keys)
    elif isinstance(levels, str):
        raise ValueError(f"unknown levels '{levels}': use rollup, cube or a list of sets of keys")
    else:
        unknown = {k for level in levels for k in level} - set(by)
        if unknown:
            raise ValueError(f"levels name keys that are none: {sorted(unknown)}")
        grouped = states.groupingSets([[named(k) for k in level] for level in levels], *keys)
    found = grouped.agg(*together.values(), F.grouping_id().cast("int").alias("__level"))
    values = found.select(*keys, "__level", *[v.alias(f"v{i}") for i, (_, _, v) in enumerate(parts)])
    cells = answer_cells(values, [(f"v{i}", {"metric_id": m.id}) for i, (m, _, _) in enumerate(parts)])
    return values.select(*keys, F.col("__level").alias("level"), F.inline(cells))
