"""Metrics: named numbers and tables computed over a dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.exact import breaks, comparable, summand
from dqspark.functions.predicates import Scope, pick_where, resolve_columns
from dqspark.functions.types import is_numeric, simple_type
from dqspark.functions.value_filters import keep_column
from dqspark.functions.values import absent, field_of, how_many, missing, named, number, share
from dqspark.operators.quantiles import exact_quantiles, quantile_kind
from dqspark.operators.scan import Frame, Keys, Probe, Scan, Table, fold, frequencies, long_values

# Fixed value: what a regular-expression check looks for when no pattern is given.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

Datasets = Mapping[str, DataFrame]
Ask = Scan | Keys | Frame | Table


class Metric:
    """A metric to compute: its type, id and parameters.

    ``where`` (or ``filter``, ``condition``, ``filter_condition``) restricts the rows;
    ``value_filter`` does so by a named value filter.
    """

    def __init__(self, type: str, id: str | None = None, dataset: str | None = None, **params: Any):
        self.type = type
        self.dataset = dataset
        self.params = params
        self.id = id or default_id(type, dataset, params)

    def column_text(self) -> str | None:
        chosen = self.params.get("column") or self.params.get("columns")
        return ", ".join(chosen) if isinstance(chosen, (list, tuple)) else chosen


@dataclass(frozen=True)
class MetricType:
    name: str
    build: Callable[[DataFrame, dict[str, Any], Datasets], Ask]
    label: str = ""
    group: str = ""
    output: Mapping[str, str] = field(default_factory=dict)
    params: tuple[str, ...] = ()  # parameters that must be given
    own_filter: bool = False  # the type reads `filter` itself: it is what it counts
    sorts: bool = False  # planning it sorts the rows, which is done once, with its condition in front


METRIC_TYPES: dict[str, MetricType] = {}


def _builtin(*names: str, label: str, group: str, own_filter: bool = False, sorts: bool = False):
    def register(build):
        for name in names:
            METRIC_TYPES[name] = MetricType(name, build, label, group, own_filter=own_filter, sorts=sorts)
        return build
    return register


def metric(
    name: str, label: str = "", group: str = "Custom", params: Sequence[str] = (),
    output: Mapping[str, str] | None = None,
):
    """Register a metric of the user's own: ``fn(df, params)``.

    It returns an aggregate Column, a dict of them with a ``value`` entry, or a DataFrame.
    ``params`` names the parameters a definition must give, ``output`` declares the columns of that
    DataFrame as string, int, float, bool or date.
    """
    def register(fn):
        def build(df, params, datasets):
            made = fn(df, params)
            if isinstance(made, DataFrame):
                return Table(made)
            values = {"value": made} if isinstance(made, Column) else dict(made)
            if pick_where(params) is None and not params.get("value_filter"):
                return Scan(lambda scope: values)  # shares the scan of its dataset
            return Frame(df.agg(*[c.alias(n) for n, c in values.items()]))
        METRIC_TYPES[name] = MetricType(name, build, label or name, group, dict(output or {}), tuple(params))
        return fn
    return register


def default_id(type_name: str, dataset: str | None, params: Mapping[str, Any]) -> str:
    """stream.project.zone.metric.type.dataset, then the column and the filter if there are any."""
    # Fixed format.
    parts = [params.get(k) or "?" for k in ("stream", "project", "zone")]
    parts += ["metric", type_name, dataset or "?"]
    column = params.get("column") or params.get("columns")
    if column:
        parts.append(f"col={column if isinstance(column, str) else column[0]}")
    where = pick_where(params)
    if where:
        parts.append(f"filter={where}")
    return ".".join(parts)


def build_probe(
    m: Metric, df: DataFrame, datasets: Datasets | None = None, dataset: str | None = None,
) -> Probe | Table:
    """What to compute for a metric on its dataset; raises when its parameters do not fit."""
    if m.type not in METRIC_TYPES:
        raise ValueError(f"unknown metric type: {m.type}")
    kind = METRIC_TYPES[m.type]
    lacking = [name for name in kind.params if m.params.get(name) is None]
    if lacking:
        raise ValueError(f"metric type '{m.type}' needs the parameters {lacking}")
    where = pick_where(m.params, ("where",) if kind.own_filter else
                       ("where", "filter", "condition", "filter_condition"))
    keep, keep_id = None, None
    if where:
        keep, keep_id = F.expr(where), f"where {where}"
    if m.params.get("value_filter"):
        by_value = keep_column(m.params["value_filter"])
        keep = by_value if keep is None else keep & by_value
        keep_id = f"{keep_id} value {m.params['value_filter']}"
    scoped = df if keep is None else df.filter(keep)
    ask = kind.build(scoped if kind.sorts else df, m.params, datasets or {})
    if isinstance(ask, (Frame, Table)) and keep is not None and not kind.sorts:
        ask = kind.build(scoped, m.params, datasets or {})
    if isinstance(ask, Table):
        ask.frame.schema
        return ask
    if isinstance(ask, Frame):
        keep, keep_id = None, None
    return Probe(m.id, dataset or m.dataset or "", df, ask, keep, keep_id)


def compute_metrics(
    df: DataFrame, metrics: Sequence[Metric], datasets: Datasets | None = None, exact: bool = False,
) -> DataFrame:
    """The values of several metrics of one dataset as (metric_id, value), in shared scans.

    With ``exact`` also their text where they are integers, decimals or moments, which a double may round.
    """
    probes = [build_probe(m, df, datasets, "") for m in metrics]
    if any(isinstance(p, Table) for p in probes):
        raise ValueError("a metric that makes a table has no value: use metric_table")
    return long_values(probes, details=False).select(F.col("key").alias("metric_id"), "value", *["exact"] * exact)


def metric_details(df: DataFrame, m: Metric, datasets: Datasets | None = None) -> DataFrame:
    """Every number behind a metric as one row, or its output table."""
    made = build_probe(m, df, datasets, "")
    if isinstance(made, Table):
        return made.frame
    if isinstance(made.ask, Frame):
        return made.ask.frame
    if isinstance(made.ask, Keys):
        rows = df if made.keep is None else df.filter(made.keep)
        counted = frequencies(rows, made.ask.columns, made.ask.digest)
        return counted.agg(*[c.alias(n) for n, c in made.ask.build(counted).items()])
    rows = df if made.keep is None else df.filter(made.keep)
    return rows.agg(*[c.alias(n) for n, c in made.ask.build(Scope()).items()])


def metric_table(df: DataFrame, m: Metric, datasets: Datasets | None = None) -> DataFrame:
    """A metric's output table: the grouped table, or the wide row of a missing rate."""
    made = build_probe(m, df, datasets, "")
    if isinstance(made, Table):
        return made.frame
    if not isinstance(made.ask, Scan) or not made.ask.table:
        raise ValueError(f"metric type '{m.type}' makes no table")
    return metric_details(df, m, datasets).select(*[
        named(c).cast("bigint" if kind == "int" else "double").alias(c)
        for c, kind in made.ask.table.items()
    ])


def declared_output(m: Metric, df: DataFrame) -> dict[str, str] | None:
    """Columns and types a table metric declares before it runs; None for a scalar."""
    if METRIC_TYPES[m.type].output:
        return dict(METRIC_TYPES[m.type].output)
    if m.type == "missing_rate":
        return missing_rate_output(resolve_columns(df, m.params.get("column") or m.params.get("columns")))
    if m.type == "aggregation_by_column":
        groups, target = _names(m.params, "group_by"), m.params["target"]
        kinds = {"string": "string", "int": "int", "double": "float", "boolean": "bool", "datetime": "date"}
        out = {g: kinds.get(simple_type(field_of(df, g).dataType), "string") for g in groups}
        return out | {"count": "int"} | {f"{fn}_{target}": "float" for fn in ("sum", "avg", "min", "max")}
    return None


def missing_rate_output(columns: Sequence[str]) -> dict[str, str]:
    out = {}
    for c in columns:
        out[f"{c}_missing_rate"] = "float"
        out[f"{c}_missing_number"] = "int"
    return out


def _names(params: Mapping[str, Any], key: str) -> list[str]:
    value = params.get(key)
    return [value] if isinstance(value, str) else list(value or [])


def _one(df: DataFrame, params: Mapping[str, Any]) -> str:
    name = params.get("column") or next(iter(_names(params, "columns")), None)
    if not name:
        raise ValueError("the metric needs a column")
    field_of(df, name)
    return name


def _expression(params: Mapping[str, Any]) -> Column:
    text = params.get("expr") or params.get("filter") or params.get("condition")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the metric needs a condition")
    return F.expr(text)


def _sum(columns: Sequence[Column]) -> Column:
    return fold(columns, lambda a, b: a + b)


# --- completeness

@_builtin("missing_rate", label="Missing rate", group="Profiling")
def _missing_rate(df, params, datasets):
    wanted = params.get("column") or params.get("columns")
    columns = resolve_columns(df, wanted)
    if not columns:
        raise ValueError(f"no valid column for missing_rate among {wanted}")

    def build(scope: Scope):
        rows = scope.rows()
        counts = {c: scope.count_if(missing(df, c)) for c in columns}
        values = {}
        for c, n in counts.items():
            values[f"{c}_missing_rate"] = share(n, rows)
            values[f"{c}_missing_number"] = n
        return {
            "value": share(_sum(list(counts.values())), rows * F.lit(len(columns))),
            "total_rows": rows, **values,
        }
    return Scan(build, table=missing_rate_output(columns))


@_builtin("null_rate", label="Null rate", group="Profiling")
def _null_rate(df, params, datasets):
    columns = [_one(df, params)] if params.get("column") else df.columns

    def build(scope):
        counts = [scope.count_if(absent(df, c)) for c in columns]
        return {"value": share(_sum(counts), scope.rows() * F.lit(len(columns)))}
    return Scan(build)


@_builtin("avg_completion_rate", label="Average completion rate", group="Profiling")
def _avg_completion_rate(df, params, datasets):
    def build(scope):
        rows = scope.rows()
        filled = [scope.count_if(~absent(df, c)) for c in df.columns]
        return {"value": share(_sum(filled), rows * F.lit(len(filled)))}
    return Scan(build)


@_builtin("table_shape", label="Table shape", group="Profiling")
def _table_shape(df, params, datasets):
    width = len(df.columns)
    numeric = sum(is_numeric(f.dataType) for f in df.schema.fields)

    def build(scope):
        return {
            "total_rows": scope.rows(), "total_columns": F.lit(width).cast("bigint"),
            "numeric_columns": F.lit(numeric).cast("bigint"),
            "shape_ratio": share(scope.rows(), F.lit(width)),
        }
    return Scan(build, value=params.get("measure", "total_rows"))


# --- counts

@_builtin("row_count", "count", label="Row count", group="Profiling")
def _row_count(df, params, datasets):
    groups = _names(params, "group_by")
    if groups:
        return Table(df.groupBy(*[named(g) for g in groups]).agg(F.count(F.lit(1)).alias("row_count")))
    return Scan(lambda scope: {"value": scope.rows()})


@_builtin("count_where", "count_condition", label="Rows matching a condition", group="Validity",
          own_filter=True)
def _count_where(df, params, datasets):
    expression = _expression(params)
    return Scan(lambda scope: {"value": scope.count_if(expression)})


@_builtin("rule_share", label="Share of rows obeying a rule", group="Validity", own_filter=True)
def _rule_share(df, params, datasets):
    expression = _expression(params)
    return Scan(lambda scope: {
        "value": share(scope.count_if(expression), scope.rows()),
        "obeying": scope.count_if(expression),
    })


@_builtin("count_out_of_range", label="Rows out of range", group="Validity")
def _count_out_of_range(df, params, datasets):
    name = _one(df, params)
    # The range used when none is given.
    low, high = params.get("low", 0.01), params.get("high", 1_000_000)
    return Scan(lambda scope: {"value": scope.count_if(breaks(df, name, low, high))})


@_builtin("regex_share", label="Share matching a pattern", group="Validity")
def _regex_share(df, params, datasets):
    name = _one(df, params)
    matches = named(name).cast("string").rlike(params.get("pattern") or EMAIL_PATTERN)

    def build(scope):
        filled = scope.count_if(named(name).isNotNull())
        return {"value": share(scope.count_if(matches), filled),
                "matches": scope.count_if(matches), "non_null": filled}
    return Scan(build)


def dates_inside(df: DataFrame, params: Mapping[str, Any]) -> tuple[Column, Column]:
    """The moment a column's value stands for, null if none, and whether it is within the bounds."""
    name = _one(df, params)
    kind = simple_type(field_of(df, name).dataType)
    if params.get("fmt") and kind == "string":
        moment = F.try_to_timestamp(named(name), F.lit(params["fmt"]))
    else:
        moment = named(name).try_cast("timestamp_ntz")
    inside = moment.isNotNull()
    for bound, low in ((params.get("low"), True), (params.get("high"), False)):
        if bound is None:
            continue
        # A bound without a time of day covers that whole day.
        target = "timestamp_ntz" if ":" in str(bound) else "date"
        value, limit = moment.cast(target), F.lit(str(bound)).try_cast(target)
        inside = inside & ((value >= limit) if low else (value <= limit))
    return moment, inside


@_builtin("date_share", label="Share of valid dates in a range", group="Validity")
def _date_share(df, params, datasets):
    moment, inside = dates_inside(df, params)
    return Scan(lambda scope: {
        "value": share(scope.count_if(inside), scope.rows()),
        "valid": scope.count_if(inside),
        "unparseable": scope.count_if(moment.isNull()),
    })


# --- numbers

@_builtin("column_sum", "sum", label="Sum of a column", group="Aggregation")
def _column_sum(df, params, datasets):
    name = _one(df, params)
    value = summand(df, name)
    return Scan(lambda scope: {
        "value": F.coalesce(scope.total(value), F.lit(0)),
        "non_null_count": scope.count_if(~absent(df, name)),
        "null_count": scope.count_if(absent(df, name)),
    })


_STATISTICS = {"avg": Scope.mean, "mean": Scope.mean, "min": Scope.least, "max": Scope.most, "std": Scope.deviation}


def _statistic(fn: str):
    def build(df, params, datasets):
        name = _one(df, params)
        value = comparable(df, name) if fn in ("min", "max") else number(df, name)
        if fn not in ("min", "max") and simple_type(field_of(df, name).dataType) == "datetime":
            raise ValueError(f"'{name}' is a moment: {fn} needs a number")
        return Scan(lambda scope: {"value": getattr(scope, _STATISTICS[fn].__name__)(value)})
    return build


for _fn in _STATISTICS:
    _builtin(_fn, label=f"{_fn} of a column", group="Aggregation")(_statistic(_fn))


@_builtin("stat", label="Statistic of a column", group="Aggregation")
def _stat(df, params, datasets):
    if params.get("fn") not in _STATISTICS:
        raise ValueError(f"unknown statistic '{params.get('fn')}': use {sorted(_STATISTICS)}")
    return _statistic(params["fn"])(df, params, datasets)


@_builtin("quantile", "median", label="Value at a rank", group="Aggregation")
def _quantile(df, params, datasets):
    """``q`` (a share, half if none) of the numbers of a column: from a sketch in the shared scan, or ``exact``."""
    name, q = _one(df, params), float(params.get("q", 0.5))
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile needs a share between 0 and 1, not {q}")
    if params.get("exact"):
        found = exact_quantiles(df, [name], [q], bool(params.get("interpolate")))
        return Frame(found.agg(F.max("value").alias("value"), F.max("n").alias("n")))
    kind = quantile_kind(df, name)
    value = comparable(df, name) if kind == "bigint" else number(df, name)
    return Scan(lambda scope: {"value": scope.quantile(value, q, kind)})


@_builtin("aggregation_by_column", label="Aggregates per group", group="Aggregation")
def _aggregation_by_column(df, params, datasets):
    groups, target = _names(params, "group_by"), params["target"]
    value = number(df, target)
    return Table(df.groupBy(*[named(g) for g in groups]).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(value).alias(f"sum_{target}"), F.avg(value).alias(f"avg_{target}"),
        F.min(value).alias(f"min_{target}"), F.max(value).alias(f"max_{target}"),
    ))


# --- keys

def _known(counted: DataFrame, columns: Sequence[str]) -> Column:
    return ~fold([absent(counted, c) for c in columns], lambda a, b: a | b)


@_builtin("unique_count", "nunique", label="Distinct values", group="Profiling")
def _unique_count(df, params, datasets):
    name = _one(df, params)
    if params.get("approx"):
        value = F.when(~absent(df, name), named(name))
        if params.get("sketch") and simple_type(field_of(df, name).dataType) not in ("string", "int"):
            value = value.cast("string")

        def build(scope):
            distinct = scope.distinct(value, params.get("sketch"))
            return {"value": distinct, "total_rows": scope.rows(),
                    "uniqueness_rate": share(distinct, scope.rows())}
        return Scan(build)

    def build_exact(counted):
        distinct = how_many(_known(counted, [name]))
        rows = F.coalesce(F.sum("n"), F.lit(0))
        return {"value": distinct, "total_rows": rows, "uniqueness_rate": share(distinct, rows)}
    return Keys((name,), build_exact, digest=bool(params.get("digest")))


@_builtin("duplicate_count", label="Repeated keys", group="Integrity")
def _duplicate_count(df, params, datasets):
    columns = tuple(_names(params, "columns") or _names(params, "column"))
    if not columns:
        raise ValueError("duplicate_count needs columns")
    for c in columns:
        field_of(df, c)
    return Keys(columns, lambda counted: {
        "value": F.coalesce(F.sum(F.col("n") - 1), F.lit(0)),
        "duplicated_keys": how_many(F.col("n") > 1),
        "rows_in_duplicates": F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)),
    }, digest=bool(params.get("digest")))


@_builtin("max_share", label="Share of the most frequent value", group="Profiling")
def _max_share(df, params, datasets):
    name = _one(df, params)

    def build(counted):
        n = F.when(_known(counted, [name]), F.col("n"))
        return {"value": share(F.max(n), F.sum(n)), "top_count": F.coalesce(F.max(n), F.lit(0))}
    return Keys((name,), build, digest=bool(params.get("digest")))


# --- between datasets

@_builtin("orphan_count", label="Keys without a reference", group="Integrity")
def _orphan_count(df, params, datasets):
    name = _one(df, params)
    if params["ref"] not in datasets:
        raise KeyError(f"reference dataset '{params['ref']}' is unknown")
    return Frame(orphan_count(df, name, datasets[params["ref"]], params.get("ref_column") or name))


def orphan_count(
    df: DataFrame, key: str | Sequence[str], ref_df: DataFrame, ref_key: str | Sequence[str],
) -> DataFrame:
    """Rows whose key is not among the reference keys; a null key refers to nothing and is no orphan.

    Keys are counted before the join, so a key that fills the table is one row when it is
    shuffled, and the join needs no further shuffle of that side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ref_keys = [ref_key] if isinstance(ref_key, str) else list(ref_key)
    names = [f"k{i}" for i in range(len(keys))]
    filled = fold([named(k).isNotNull() for k in keys], lambda a, b: a & b)
    counted = (
        df.filter(filled).select(*[named(k).alias(n) for k, n in zip(keys, names)])
        .groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    )
    known = ref_df.select(*[named(k).alias(n) for k, n in zip(ref_keys, names)]).distinct()
    return counted.join(known, names, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("value"),
        F.count(F.lit(1)).alias("orphan_keys"),
    )
