"""Row conditions: SQL text, the rows a metric looks at, and the columns it needs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from dqspark.functions.values import how_many

# The keys under which a definition may carry a row condition, first wins.
WHERE_KEYS = ("where", "filter", "condition", "filter_condition")


def pick_where(spec: Mapping[str, Any], keys: Iterable[str] = WHERE_KEYS) -> str | None:
    for key in keys:
        if spec.get(key):
            return spec[key]
    return None


class Scope:
    """The rows one metric looks at.

    Metrics with different conditions still share one scan: the condition goes inside each
    aggregate instead of in front of it.
    """

    def __init__(self, keep: Column | None = None):
        self.keep = keep

    def only(self, value: Column) -> Column:
        return value if self.keep is None else F.when(self.keep, value)

    def rows(self) -> Column:
        return F.count(F.lit(1)) if self.keep is None else how_many(self.keep)

    def count_if(self, condition: Column) -> Column:
        return how_many(condition if self.keep is None else self.keep & condition)

    def total(self, value: Column) -> Column:
        return F.sum(self.only(value))

    def least(self, value: Column) -> Column:
        return F.min(self.only(value))

    def most(self, value: Column) -> Column:
        return F.max(self.only(value))

    def mean(self, value: Column) -> Column:
        return F.avg(self.only(value))

    def deviation(self, value: Column) -> Column:
        return F.stddev_samp(self.only(value))

    def distinct(self, value: Column, sketch: str | None = None) -> Column:
        """About how many values there are; ``sketch`` as in ``sketched_distinct``."""
        return F.approx_count_distinct(self.only(value)) if sketch is None else DISTINCT[sketch][1](DISTINCT[sketch][0](self.only(value)))

    def quantile(self, value: Column, rank: float, kind: str) -> Column:
        """About the value at a share of the order, from a KLL sketch of ``bigint`` or ``double`` values."""
        return sketched_quantile(QUANTILE[kind][0](self.only(value), F.lit(SKETCH_SIZE)), rank, kind)


#: Values a KLL sketch holds on its lowest level: the rank it gives is off by about 2.3 / SKETCH_SIZE ** 0.9 at most.
SKETCH_SIZE = 2000
#: How values are sketched and counted: HyperLogLog, or theta, whose sketches can also be intersected.
DISTINCT = {"hll": (F.hll_sketch_agg, F.hll_sketch_estimate), "theta": (F.theta_sketch_agg, F.theta_sketch_estimate)}
QUANTILE = {
    "bigint": (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint, F.kll_sketch_get_n_bigint),
    "double": (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double, F.kll_sketch_get_n_double)}


def sketched_quantile(sketch: Column, rank: float, kind: str) -> Column:
    """The value at a rank of a KLL sketch, null if it holds none."""
    _, value, n = QUANTILE[kind]
    return F.when(n(sketch) > 0, value(sketch, F.lit(float(rank))))


def resolve_columns(df: DataFrame, wanted: str | Iterable[str] | None) -> list[str]:
    """Known columns in the order asked for, each once; all columns when none is asked for."""
    if wanted is None or wanted == "":
        return list(df.columns)
    names = [wanted] if isinstance(wanted, str) else [n for n in wanted if n]
    if not names:
        return list(df.columns)
    known = set(df.columns)
    return [n for n in dict.fromkeys(names) if n in known]


def predicate_columns(spark: SparkSession, predicate: str, df: DataFrame | None = None) -> list[str]:
    """Columns a condition reads, found by asking the analyzer, without running anything.

    Starting from a frame with no columns, each analysis names one column it cannot resolve;
    that column is added, with its type in ``df`` when it is there, until the condition resolves.
    """
    types = {f.name.lower(): f.dataType for f in df.schema.fields} if df is not None else {}
    found: dict[str, Column] = {}
    while True:
        frame = spark.range(0).select(*found.values())
        try:
            frame.filter(F.expr(predicate)).schema
            return list(found)
        except AnalysisException as error:
            condition = error.getCondition() or ""
            if not condition.startswith("UNRESOLVED_COLUMN"):
                if found:
                    return list(found)
                raise
            name = error.getMessageParameters()["objectName"].split("`.`")[0].strip("`")
            if name in found:
                return list(found)
            value = F.lit(None)
            if name.lower() in types:
                value = value.cast(types[name.lower()])
            found[name] = value.alias(name)
