"""Numbers that a double would round: keys beyond 2^53, money as decimals, moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import run_suite
from dqspark.operators import investigate_bounds
from examples.tables import table

# Keys above 2^53, where every other integer is no double.
LARGE_COLUMNS = (
    "l_orderkey + 9007199254740992 as big_key", "l_linenumber", "cast(l_extendedprice as decimal(15, 2)) as price",
    "cast(l_shipdate as date) as shipped",
)
LARGE_SQL = f"select {', '.join(LARGE_COLUMNS)} from lineitem"
MIDDLE = 9007199254741993  # odd, so its double is another number


def large_lineitem(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*LARGE_COLUMNS)


def exact_metrics(spark, sf):
    """Extremes and sums as they are, beside the doubles of a suite."""
    asked = [("max", "big_key"), ("min", "big_key"), ("sum", "big_key"), ("max", "price"), ("sum", "price"), ("min", "shipped"), ("max", "shipped")]
    suite = {"metrics": [{"id": f"{fn} {c}", "type": fn, "column": c} for fn, c in asked] + [
        {"id": "outside", "type": "count_out_of_range", "column": "big_key", "low": MIDDLE, "high": MIDDLE + 2},
        {"id": "avg shipped", "type": "avg", "column": "shipped"}]}
    return run_suite(spark, {"lineitem": large_lineitem(spark, sf)}, suite, investigations=False).metrics.select("metric_id", "exact", "status")


def exact_checks(spark, sf):
    """Verdicts at bounds that a double would move: on columns and on metrics."""
    suite = {"metrics": [{"id": "least", "type": "min", "column": "big_key"}], "tests": [
        {"id": "not above", "type": "interval_check", "columns": ["big_key"], "upper": MIDDLE},
        {"id": "not above text", "type": "interval_check", "columns": ["big_key"], "upper": str(MIDDLE)},
        {"id": "below", "type": "range", "columns": ["big_key"], "low": 0, "high": MIDDLE, "inclusive": False},
        {"id": "price", "type": "interval_check", "columns": ["price"], "upper": 50000.01},
        {"id": "half a key", "type": "interval_check", "columns": ["big_key"], "upper": f"{MIDDLE}.5"},
        {"id": "rules", "type": "interval_check", "columns": ["price"], "lower": 0,
         "column_rules": [{"columns": ["big_key"], "lower": MIDDLE}]},
        {"id": "least is odd", "type": "threshold", "metric": "least", "operator": "=", "value": 9007199254740993},
        {"id": "least is even", "type": "threshold", "metric": "least", "operator": "=", "value": 9007199254740992},
        {"id": "least at most", "type": "interval_check", "metric_id": "least", "upper": 9007199254740992}]}
    found = run_suite(spark, {"lineitem": large_lineitem(spark, sf)}, suite, investigations=False).tests
    return found.select("test_id", F.when(F.col("metric_id").isNull(), F.col("value")).alias("violations"), "status")


def exact_sample(spark, sf):
    """The rows of the smallest keys out of bounds by one."""
    return investigate_bounds(large_lineitem(spark, sf), {"big_key": (None, MIDDLE)}, key=["big_key", "l_linenumber", "price"], n=50)


QUERIES = {"exact_metrics": exact_metrics, "exact_checks": exact_checks, "exact_sample": exact_sample}

_ASKED = " union all ".join(
    f"select '{fn} {c}' as metric_id, cast({fn}({c}) as varchar) as exact, 'SUCCESS' as status from t" for fn, c in (
        ("max", "big_key"), ("min", "big_key"), ("sum", "big_key"), ("max", "price"), ("sum", "price"), ("min", "shipped"), ("max", "shipped")))


def _judged(test_id: str, broken: str) -> str:
    return f"select '{test_id}' as test_id, cast(count(*) filter ({broken}) as double) as violations, if(count(*) filter ({broken}) = 0, 'SUCCESS', 'FAIL') as status from t"


ORACLES = {
    "exact_metrics": f"""
        with t as ({LARGE_SQL}) {_ASKED}
        union all select 'outside', cast(count(*) filter (big_key not between {MIDDLE} and {MIDDLE + 2}) as varchar), 'SUCCESS' from t
        union all select 'avg shipped', null, 'ERROR'""",
    "exact_checks": f"with t as ({LARGE_SQL}) " + " union all ".join((
        _judged("not above", f"big_key > {MIDDLE}"), _judged("not above text", f"big_key > {MIDDLE}"),
        _judged("below", f"big_key >= {MIDDLE}"), _judged("price", "price > 50000.01"), _judged("half a key", f"big_key > {MIDDLE}"),
        _judged("rules", f"big_key < {MIDDLE}"))) + """
        union all select 'least is odd', null, if(min(big_key) = 9007199254740993, 'SUCCESS', 'FAIL') from t
        union all select 'least is even', null, if(min(big_key) = 9007199254740992, 'SUCCESS', 'FAIL') from t
        union all select 'least at most', null, if(min(big_key) <= 9007199254740992, 'SUCCESS', 'FAIL') from t""",
    "exact_sample": f"select * from ({LARGE_SQL}) where big_key > {MIDDLE} order by big_key, l_linenumber, price limit 50",
}
