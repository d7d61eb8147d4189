"""Tests over metric values and over dataset columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import Metric, check, run_suite
from dqspark.functions import local_frame
from dqspark.operators import (
    assert_output_schema, compute_metrics, declared_output, interval_check_columns, metric_checks,
    metric_table, metric_tests, range_columns, regex_check,
)
from examples.tables import DIRTY_SQL, MISSING_SEGMENT, dirty_customer, table


def _metric_verdicts(spark, df, metrics, tests):
    """Verdicts of tests on metric values, computed and judged in one lazy plan."""
    values = compute_metrics(df, metrics).select(
        "metric_id", F.lit("customer").alias("dataset"), F.lit(None).cast("string").alias("column"),
        "value", F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error"))
    return metric_checks(metric_tests(spark, tests), values).select(
        "test_id", F.round("value", 6).alias("value"), "passed", "status", "message")


NEGATIVE = Metric("count_where", id="negative", filter="c_acctbal < 0")
ROWS = Metric("row_count", id="rows")
SEGMENT = Metric("missing_rate", id="segment", column="c_mktsegment")


def interval_check_metric(spark, sf):
    return _metric_verdicts(spark, dirty_customer(spark, sf), [SEGMENT, NEGATIVE], [
        {"id": "segment_filled", "type": "interval_check", "metric_id": "segment", "upper": 0.5},
        {"id": "none_negative", "type": "interval_check", "metric_id": "negative", "lower": 0, "upper": 0},
        {"id": "many_negative", "type": "interval_check", "metric_id": "negative", "lower": 100000000},
        {"id": "no_bound", "type": "interval_check", "metric_id": "negative"},
        {"id": "unknown", "type": "interval_check", "metric_id": "nothing", "upper": 1}])


def range_check(spark, sf):
    return _metric_verdicts(spark, dirty_customer(spark, sf), [SEGMENT, NEGATIVE, ROWS], [
        {"id": "inside", "type": "range", "metric_id": "segment", "lower": 0, "upper": 1},
        {"id": "edge_excluded", "type": "range", "metric_id": "rows", "lower": 0, "upper": 0, "inclusive": False},
        {"id": "below", "type": "range", "metric_id": "negative", "lower": -2, "upper": -1},
        {"id": "text_bound", "type": "range", "metric_id": "negative", "lower": "many", "upper": 9}])


def threshold_check(spark, sf):
    tests = [
        {"id": f"negative {op} 0", "type": "threshold", "metric_id": "negative", "op": op, "target": 0}
        for op in ("=", "==", "!=", ">=", "<=", ">", "<")]
    return _metric_verdicts(spark, dirty_customer(spark, sf), [NEGATIVE], tests)


def interval_check_cols(spark, sf):
    return interval_check_columns(
        table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_phone", "c_mktsegment"], 0, 9000)


def interval_check_rules(spark, sf):
    counts = interval_check_columns(
        table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], lower=0, upper=0.05,
        column_rules=[{"columns": ["l_quantity"], "lower": 5, "upper": 45},
                      {"columns": ["l_extendedprice"], "upper_value": 90000}],
        per_column=True)
    return counts.select("column", "lower", "upper", "checked", "violations")


def range_cols(spark, sf):
    closed = range_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 0, 50, test_id="closed")
    opened = range_columns(
        table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 0, 50, inclusive=False, test_id="open")
    return closed.unionByName(opened)


def regex_checks(spark, sf):
    names = regex_check(table(spark, sf, "supplier"), "s_name", r"^Supplier#[0-9]{9}$", test_id="names")
    urls = regex_check(table(spark, sf, "pages"), "url", r"^https://", test_id="secure_urls")
    return names.unionByName(urls)


def _suite_tests(spark, datasets, suite):
    return run_suite(spark, datasets, suite, investigations=False).tests.select(
        "test_id", F.round("value", 6).alias("value"), "passed", "status", "message")


def virtual_dataset_check(spark, sf):
    datasets = {"customer": dirty_customer(spark, sf), "orders": table(spark, sf, "orders")}
    return _suite_tests(spark, datasets, {
        "metrics": [
            {"id": "M-001", "type": "missing_rate", "dataset": "customer", "column": "c_mktsegment"},
            {"id": "by_status", "type": "aggregation_by_column", "dataset": "orders",
             "group_by": ["o_orderstatus", "o_orderpriority"], "target": "o_totalprice"}],
        "tests": [
            {"id": "rule_on_output", "type": "interval_check", "metric_id": "M-001", "target_mode": "metric_value",
             "column_rules": [{"columns": ["c_mktsegment_missing_rate"], "lower": None, "upper": 0.5}]},
            {"id": "rule_broken", "type": "interval_check", "metric_id": "M-001",
             "column_rules": [{"columns": ["c_mktsegment_missing_number"], "upper": 0}]},
            {"id": "groups_large", "type": "interval_check", "dataset": "virtual:by_status",
             "columns": ["count"], "lower": 1000},
            {"id": "unknown_output", "type": "interval_check", "dataset": "virtual:M-002",
             "columns": ["x"], "lower": 0}]})


def columns_present_check(spark, sf):
    """Presence beside a data-driven test of the same dataset."""
    return _suite_tests(spark, {"orders": table(spark, sf, "orders")}, {
        "metrics": [{"id": "rows", "type": "row_count", "dataset": "orders"}],
        "tests": [
            {"id": "has_keys", "type": "columns_present", "dataset": "orders",
             "columns": ["o_orderkey", "o_custkey"]},
            {"id": "has_currency", "type": "columns_present", "dataset": "orders",
             "columns": ["o_orderkey", "currency", "branch"]},
            {"id": "not_empty", "type": "threshold", "metric": "rows", "operator": ">", "value": 0}]})


def columns_typed_check(spark, sf):
    return _suite_tests(spark, {"orders": table(spark, sf, "orders")}, {
        "metrics": [{"id": "rows", "type": "row_count", "dataset": "orders"}],
        "tests": [
            {"id": "typed", "type": "columns_typed", "dataset": "orders",
             "types": {"o_orderkey": "I", "o_totalprice": "N", "o_orderdate": "T", "o_orderstatus": "S"}},
            {"id": "mistyped", "type": "columns_typed", "dataset": "orders",
             "types": {"o_totalprice": "S", "o_orderdate": "D", "o_clerk": "S", "o_orderstatus": "B"}},
            {"id": "not_empty", "type": "threshold", "metric": "rows", "operator": ">", "value": 0}]})


def dataset_profile_checks(spark, sf):
    return _suite_tests(spark, {"customer": dirty_customer(spark, sf)}, {
        "metrics": [
            {"id": "rows", "type": "row_count"}, {"id": "completion", "type": "avg_completion_rate"},
            {"id": "numeric", "type": "table_shape", "measure": "numeric_columns"}],
        "tests": [
            {"id": "non_empty_dataset", "type": "threshold", "metric": "rows", "operator": ">", "value": 0},
            {"id": "min_completion_check", "type": "threshold", "metric": "completion", "op": ">=", "value": 0.95},
            {"id": "numeric_columns_presence", "type": "threshold", "metric": "numeric", "op": ">=", "value": 1}]})


def foreign_key_check(spark, sf):
    names = ("documents", "labels", "lineitem", "orders")
    return _suite_tests(spark, {n: table(spark, sf, n) for n in names}, {"tests": [
        {"id": "labelled", "type": "foreign_key", "dataset": "documents", "column": "doc_id", "ref": "labels.doc_id"},
        {"id": "ordered", "type": "foreign_key", "dataset": "lineitem", "column": "l_orderkey",
         "ref": "orders", "ref_column": "o_orderkey"}]})


def business_checks(spark, sf):
    return _suite_tests(spark, {"events": table(spark, sf, "events")}, {
        "metrics": [
            {"id": "negative", "type": "count_where", "dataset": "events", "filter": "value < 0"},
            {"id": "range", "type": "count_out_of_range", "dataset": "events", "column": "value",
             "low": 0.01, "high": 100},
            {"id": "duplicates", "type": "duplicate_count", "dataset": "events", "columns": ["event_id"]}],
        "tests": [
            {"id": "no_negative_amounts", "type": "threshold", "metric": "negative", "threshold": 0},
            {"id": "amounts_in_range", "type": "threshold", "metric": "range", "threshold": 0},
            {"id": "no_duplicate_ids", "type": "threshold", "metric": "duplicates", "threshold": 0}]})


def output_schema_check(spark, sf):
    """The declared columns of a table metric against the actual ones, with the groups it made."""
    orders = table(spark, sf, "orders")
    m = Metric("aggregation_by_column", group_by="o_orderstatus", target="o_totalprice")
    made = metric_table(orders, m)
    facts = assert_output_schema(made, declared_output(m, orders)).withColumn("declared_by", F.lit("metric"))
    wrong = assert_output_schema(made, {"o_orderstatus": "string", "count": "string", "median": "float"})
    groups = made.agg(F.count(F.lit(1)).alias("groups"))
    both = facts.unionByName(wrong.withColumn("declared_by", F.lit("hand")))
    return both.withColumn("one", F.lit(1)).join(groups.withColumn("one", F.lit(1)), "one").select(
        "declared_by", "column", "expected", "passed", "groups")


@check("order_totals")
def _order_totals(context, params):
    """Revenue of the lines of each status against a floor: one row per status."""
    lines = context.load("lineitem").groupBy("l_linestatus").agg(
        F.sum(F.col("l_extendedprice")).alias("value"))
    return lines.select(
        F.concat(F.lit("revenue_"), "l_linestatus").alias("id"), F.round("value", 2).alias("value"),
        (F.col("value") >= params["floor"]).alias("passed"),
        F.lit("revenue of the line status").alias("message"))


@check("broken_check")
def _broken(context, params):
    return context.load("lineitem").select("l_orderkey")


@check("rows_seen")
def _rows_seen(context, params):
    """Uses a value the suite computed before it."""
    seen = context.metrics["rows"]
    return local_frame(
        context.spark, [("rows_seen", seen, seen >= params["least"], "rows the suite counted")],
        "id string, value double, passed boolean, message string")


def custom_check(spark, sf):
    result = run_suite(spark, {"lineitem": table(spark, sf, "lineitem")}, {
        "metrics": [{"id": "rows", "type": "row_count"}],
        "scripts": [
            {"id": "totals", "check": "order_totals", "execute_on": "pre_dq", "params": {"floor": 1e9}},
            {"id": "seen", "check": "rows_seen", "params": {"least": 1000}},
            {"id": "broken_check", "execute_on": "independent"},
            {"id": "off", "check": "rows_seen", "enabled": False}]})
    return result.tests.select("test_id", "value", "passed", "status", "message")


QUERIES = {
    "interval_check_metric": interval_check_metric, "interval_check_columns": interval_check_cols,
    "interval_check_rules": interval_check_rules, "range_check": range_check,
    "range_columns": range_cols, "threshold_check": threshold_check, "regex_check": regex_checks,
    "virtual_dataset_check": virtual_dataset_check, "columns_present": columns_present_check,
    "columns_typed": columns_typed_check, "dataset_profile_checks": dataset_profile_checks,
    "foreign_key_check": foreign_key_check, "business_checks": business_checks,
    "output_schema_check": output_schema_check, "custom_check": custom_check,
}

_FIGURES = f"""
    with d as ({DIRTY_SQL}), m as (
        select count(*)::double as n, count(*) filter (c_acctbal < 0)::double as neg,
               count(*) filter ({MISSING_SEGMENT})::double / count(*) as seg from d)"""

_THRESHOLDS = " union all ".join(
    f"select 'negative {op} 0' as test_id, neg as value, neg {sql} 0 as passed, "
    f"case when neg {sql} 0 then 'SUCCESS' else 'FAIL' end as status, "
    f"case when neg {sql} 0 then 'OK' else neg::varchar || ' is not {op} 0.0' end as message from m"
    for op, sql in (("=", "="), ("==", "="), ("!=", "!="), (">=", ">="), ("<=", "<="), (">", ">"), ("<", "<")))


def _threshold(test_id: str, value: str, op: str, target: str, source: str) -> str:
    return f"""
        select '{test_id}' as test_id, round(v, 6) as value, v {op} {target} as passed,
               case when v {op} {target} then 'SUCCESS' else 'FAIL' end as status,
               case when v {op} {target} then 'OK' else v::varchar || ' is not {op} ' || ({target}::double)::varchar
               end as message from (select ({value})::double as v from {source})"""


ORACLES = {
    "interval_check_metric": _FIGURES + """
        select 'segment_filled' as test_id, round(seg, 6) as value, seg <= 0.5 as passed,
               case when seg <= 0.5 then 'SUCCESS' else 'FAIL' end as status,
               case when seg <= 0.5 then 'OK' else seg::varchar || ' > max 0.5' end as message from m
        union all select 'none_negative', neg, neg = 0, case when neg = 0 then 'SUCCESS' else 'FAIL' end,
               case when neg = 0 then 'OK' else neg::varchar || ' > max 0.0' end from m
        union all select 'many_negative', neg, neg >= 1e8, case when neg >= 1e8 then 'SUCCESS' else 'FAIL' end,
               case when neg >= 1e8 then 'OK' else neg::varchar || ' < min 100000000.0' end from m
        union all select 'no_bound', null, false, 'FAIL', 'Define at least one bound (min or max).'
        union all select 'unknown', null, false, 'FAIL', 'Metric ''nothing'' not found or not computed.'""",
    "range_check": _FIGURES + """
        select 'inside' as test_id, round(seg, 6) as value, seg between 0 and 1 as passed, 'SUCCESS' as status,
               'OK' as message from m
        union all select 'edge_excluded', n, false, 'FAIL', 'value ' || n::varchar || ' out of range (0.0, 0.0)' from m
        union all select 'below', neg, false, 'FAIL', 'value ' || neg::varchar || ' out of range [-2.0, -1.0]' from m
        union all select 'text_bound', null, false, 'FAIL', 'Incomparable types: ''many'' is not a number'""",
    "threshold_check": _FIGURES + _THRESHOLDS,
    "interval_check_columns": """
        with b as (select count(*) filter (c_acctbal < 0 or c_acctbal > 9000) as bad,
                          count(c_acctbal) as n,
                          count(*) filter (c_nationkey < 0 or c_nationkey > 9000) as bad_nations from customer)
        select 'interval_check' as test_id, (bad + bad_nations)::double as value, false as passed, 'FAIL' as status,
               'Missing columns: c_phone; ' || bad || '/' || n || ' out of bounds in ''c_acctbal''; '
               || 'Columns without numeric values: c_mktsegment' as message from b""",
    "interval_check_rules": """
        select 'l_quantity' as "column", 5.0::double as lower, 45.0::double as upper, count(l_quantity) as checked,
               count(*) filter (l_quantity < 5 or l_quantity > 45) as violations from lineitem
        union all select 'l_discount', 0, 0.05, count(l_discount),
               count(*) filter (l_discount < 0 or l_discount > 0.05::double) from lineitem
        union all select 'l_tax', 0, 0.05, count(l_tax),
               count(*) filter (l_tax < 0 or l_tax > 0.05::double) from lineitem
        union all select 'l_extendedprice', null, 90000, count(l_extendedprice),
               count(*) filter (l_extendedprice > 90000) from lineitem""",
    "range_columns": """
        with b as (select count(*) as n, count(*) filter (l_quantity <= 0 or l_quantity >= 50) as q,
                          count(*) filter (l_tax <= 0 or l_tax >= 50) as t from lineitem)
        select 'closed' as test_id, 0.0::double as value, true as passed, 'SUCCESS' as status,
               'All values (' || (2 * n) || ') respect the configured bounds.' as message from b
        union all select 'open', (q + t)::double, false, 'FAIL', q || '/' || n || ' out of bounds in ''l_quantity''; '
               || t || '/' || n || ' out of bounds in ''l_tax''' from b""",
    "regex_check": """
        select 'names' as test_id, 0.0::double as value, true as passed, 'SUCCESS' as status,
               'All values (' || count(s_name) || ') match.' as message
        from supplier where regexp_matches(s_name, '^Supplier#[0-9]{9}$')
        union all select 'secure_urls', bad::double, false, 'FAIL', bad || '/' || n || ' not matching in ''url'''
        from (select count(*) filter (not regexp_matches(url, '^https://')) as bad, count(url) as n from pages)""",
    "virtual_dataset_check": f"""
        with d as ({DIRTY_SQL}), m as (select count(*) filter ({MISSING_SEGMENT}) as bad from d),
             g as (select count(*) as n from orders group by o_orderstatus, o_orderpriority),
             s as (select count(*) filter (n < 1000) as small, count(*) as n from g)
        select 'rule_on_output' as test_id, 0.0::double as value, true as passed, 'SUCCESS' as status,
               'All values (1) respect the configured bounds.' as message
        union all select 'rule_broken', 1.0, false, 'FAIL', '1/1 out of bounds in ''c_mktsegment_missing_number'''
               from m where bad > 0
        union all select 'groups_large', small::double, small = 0, case when small = 0 then 'SUCCESS' else 'FAIL' end,
               case when small = 0 then 'All values (' || n || ') respect the configured bounds.'
               else small || '/' || n || ' out of bounds in ''count''' end from s
        union all select 'unknown_output', null, false, 'ERROR',
               'dataset ''virtual:M-002'' is unknown; known are [''customer'', ''orders'', ''virtual:M-001'', '
               || '''virtual:by_status'']'""",
    "columns_present": """
        select 'has_keys' as test_id, 0.0::double as value, true as passed, 'SUCCESS' as status, 'OK' as message
        union all select 'has_currency', 2.0, false, 'FAIL', 'column ''currency'' is missing; column ''branch'' is missing'
        union all select 'not_empty', count(*)::double, count(*) > 0, 'SUCCESS', 'OK' from orders""",
    "columns_typed": """
        select 'typed' as test_id, 0.0::double as value, true as passed, 'SUCCESS' as status, 'OK' as message
        union all select 'mistyped', 3.0, false, 'FAIL', '''o_totalprice'' is double, expected S; '
               || 'column ''o_clerk'' is missing; ''o_orderstatus'' is string, expected B'
        union all select 'not_empty', count(*)::double, count(*) > 0, 'SUCCESS', 'OK' from orders""",
    "dataset_profile_checks": f"with d as ({DIRTY_SQL})" + " union all ".join([
        _threshold("non_empty_dataset", "count(*)", ">", "0", "d"),
        _threshold("min_completion_check",
                   "(count(c_custkey) + count(c_mktsegment) + count(c_acctbal))::double / (3 * count(*))",
                   ">=", "0.95", "d"),
        _threshold("numeric_columns_presence", "2", ">=", "1", "(select 1)")]),
    "foreign_key_check": """
        with o as (select count(*) as n from documents d anti join labels l on d.doc_id = l.doc_id),
             p as (select count(*) as n from lineitem anti join orders on l_orderkey = o_orderkey)
        select 'labelled' as test_id, n::double as value, n = 0 as passed,
               case when n = 0 then 'SUCCESS' else 'FAIL' end as status,
               case when n = 0 then 'OK' else n || ' rows refer to no row of ''labels''' end as message from o
        union all select 'ordered', n::double, n = 0, case when n = 0 then 'SUCCESS' else 'FAIL' end,
               case when n = 0 then 'OK' else n || ' rows refer to no row of ''orders''' end from p""",
    "business_checks": " union all ".join([
        _threshold("no_negative_amounts", "count(*) filter (value < 0)", "=", "0", "events"),
        _threshold("amounts_in_range", "count(*) filter (value < 0.01 or value > 100)", "=", "0", "events"),
        _threshold("no_duplicate_ids", "count(*) - count(distinct event_id)", "=", "0", "events")]),
    "output_schema_check": """
        with g as (select count(distinct o_orderstatus) as n from orders),
        f(declared_by, "column", expected, passed) as (values
            ('metric', 'o_orderstatus', 'string', true), ('metric', 'count', 'int', true),
            ('metric', 'sum_o_totalprice', 'float', true), ('metric', 'avg_o_totalprice', 'float', true),
            ('metric', 'min_o_totalprice', 'float', true), ('metric', 'max_o_totalprice', 'float', true),
            ('hand', 'o_orderstatus', 'string', true), ('hand', 'count', 'string', false),
            ('hand', 'median', 'float', false), ('hand', 'sum_o_totalprice', 'none', false),
            ('hand', 'avg_o_totalprice', 'none', false), ('hand', 'min_o_totalprice', 'none', false),
            ('hand', 'max_o_totalprice', 'none', false))
        select declared_by, "column", expected, passed, n as groups from f, g""",
    "custom_check": """
        select 'revenue_' || l_linestatus as test_id, round(sum(l_extendedprice), 2) as value,
               sum(l_extendedprice) >= 1e9 as passed,
               case when sum(l_extendedprice) >= 1e9 then 'SUCCESS' else 'FAIL' end as status,
               'revenue of the line status' as message
        from lineitem group by l_linestatus
        union all select 'rows_seen', count(*)::double, count(*) >= 1000, 'SUCCESS', 'rows the suite counted' from lineitem
        union all select 'broken_check', null, false, 'ERROR',
               'custom check ''broken_check'' lacks the columns [''id'', ''value'', ''passed'', ''message'']'
        union all select 'off', null, null, 'SKIPPED', 'The script is disabled.'""",
}
