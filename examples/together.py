"""Suites that share their scans, and the checks of the conditions that tests are written with."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import run_suite, run_suites
from examples.tables import table

# Two suites over the same tables, with ids in common that mean something else in each.
PRICES = {
    "id": "prices", "keys": {"lines": "l_orderkey"},
    "metrics": [
        {"id": "dear", "type": "count_where", "dataset": "lines", "filter": "l_extendedprice > 50000"},
        {"id": "quantity", "type": "column_sum", "dataset": "lines", "column": "l_partkey"},
        {"id": "by_flag", "type": "aggregation_by_column", "dataset": "lines", "group_by": "l_returnflag", "target": "l_linenumber"}],
    "tests": [
        {"id": "bounded", "type": "interval_check", "dataset": "lines", "columns": ["l_discount"], "upper": 0.05, "where": "l_tax > 0.02"},
        {"id": "few", "type": "threshold", "metric": "dear", "operator": "<=", "value": 10},
        {"id": "flags", "type": "interval_check", "dataset": "virtual:by_flag", "columns": ["sum_l_linenumber"], "lower": 1}]}
DATES = {
    "id": "dates", "keys": {"lines": "l_orderkey"},
    "metrics": [
        {"id": "dear", "type": "count_where", "dataset": "orders", "filter": "o_totalprice > 200000"},
        {"id": "by_flag", "type": "aggregation_by_column", "dataset": "lines", "group_by": "l_returnflag", "target": "l_suppkey"}],
    "tests": [
        {"id": "bounded", "type": "interval_check", "dataset": "lines", "columns": ["l_quantity"], "lower": 2, "where": "l_tax > 0.02"},
        {"id": "known", "type": "foreign_key", "dataset": "lines", "column": "l_orderkey", "ref": "orders.o_orderkey"},
        {"id": "flags", "type": "interval_check", "dataset": "virtual:by_flag", "columns": ["sum_l_suppkey"], "upper": 1}]}


def suites_together(spark, sf):
    """Metrics and verdicts of both, from one scan of each table."""
    results = run_suites(spark, {"lines": table(spark, sf, "lineitem"), "orders": table(spark, sf, "orders")}, [PRICES, DATES])
    parts = []
    for r in results:
        parts.append(r.metrics.select("suite_id", F.col("metric_id").alias("id"), F.round("value", 4).alias("value"), "status"))
        parts.append(r.tests.select("suite_id", F.col("test_id").alias("id"), F.lit(None).cast("double").alias("value"), "status"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


CONDITIONS = {
    "id": "conditions",
    "tests": [
        {"id": "priced", "type": "interval_check", "dataset": "orders", "columns": ["o_totalprice"], "lower": 1000,
         "where": "o_orderstatus = 'F' and o_custkey > 10"},
        {"id": "lost", "type": "interval_check", "dataset": "orders", "columns": ["o_totalprice"], "lower": 0,
         "where": "o_clerk = 'x' and o_custkey > 10"},
        {"id": "mistyped", "type": "interval_check", "dataset": "orders", "columns": ["o_totalprice"], "lower": 0,
         "where": "array_contains(o_custkey, 3)"}]}


def technical_checks(spark, sf):
    """Each condition's columns and types beside the test itself, which a faulty condition breaks."""
    tests = run_suite(spark, {"orders": table(spark, sf, "orders")}, CONDITIONS, technical_checks=True, investigations=False).tests
    return tests.select("test_id", "type", F.when(F.col("status") != "ERROR", F.col("value")).alias("value"), "status")


QUERIES = {"suites_together": suites_together, "technical_checks": technical_checks}

_PRESENT, _FITS = ("filter_columns_presence", "filter_columns_type_match")

ORACLES = {
    "suites_together": """
        select 'prices' as suite_id, 'dear' as id, count(*) filter (l_extendedprice > 50000)::double as value, 'SUCCESS' as status from lineitem
        union all select 'prices', 'quantity', round(sum(l_partkey)::double, 4), 'SUCCESS' from lineitem
        union all select 'prices', 'by_flag', count(distinct l_returnflag)::double, 'SUCCESS' from lineitem
        union all select 'prices', 'bounded', null, case when count(*) filter (l_tax > 0.02 and l_discount > 0.05) = 0 then 'SUCCESS' else 'FAIL' end from lineitem
        union all select 'prices', 'few', null, case when count(*) filter (l_extendedprice > 50000) <= 10 then 'SUCCESS' else 'FAIL' end from lineitem
        union all select 'prices', 'flags', null, case when min(n) >= 1 then 'SUCCESS' else 'FAIL' end
            from (select sum(l_linenumber) as n from lineitem group by l_returnflag)
        union all select 'dates', 'dear', count(*) filter (o_totalprice > 200000)::double, 'SUCCESS' from orders
        union all select 'dates', 'by_flag', count(distinct l_returnflag)::double, 'SUCCESS' from lineitem
        union all select 'dates', 'bounded', null, case when count(*) filter (l_tax > 0.02 and l_quantity < 2) = 0 then 'SUCCESS' else 'FAIL' end from lineitem
        union all select 'dates', 'known', null, case when count(*) = 0 then 'SUCCESS' else 'FAIL' end
            from lineitem anti join orders on l_orderkey = o_orderkey where l_orderkey is not null
        union all select 'dates', 'flags', null, case when max(n) <= 1 then 'SUCCESS' else 'FAIL' end
            from (select sum(l_suppkey) as n from lineitem group by l_returnflag)""",
    "technical_checks": f"""
        with t as (select count(*) filter (o_totalprice < 1000)::double as n from orders where o_orderstatus = 'F' and o_custkey > 10)
        select 'priced' as test_id, 'interval_check' as type, n as value, case when n = 0 then 'SUCCESS' else 'FAIL' end as status from t
        union all select 'lost', 'interval_check', null, 'ERROR' union all select 'mistyped', 'interval_check', null, 'ERROR'
        union all select 'priced_implicit_columns_presence', '{_PRESENT}', 0, 'SUCCESS' union all select 'priced_implicit_columns_type', '{_FITS}', 0, 'SUCCESS'
        union all select 'lost_implicit_columns_presence', '{_PRESENT}', 1, 'FAIL' union all select 'lost_implicit_columns_type', '{_FITS}', 1, 'FAIL'
        union all select 'mistyped_implicit_columns_presence', '{_PRESENT}', 0, 'SUCCESS' union all select 'mistyped_implicit_columns_type', '{_FITS}', 1, 'FAIL'""",
}
