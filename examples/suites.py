"""Suites, their reports and the samples of offending rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import consolidate, run_suite
from dqspark.operators import (
    investigate_bounds, investigate_duplicates, investigate_missing, investigate_where,
)
from dqspark.plans import (
    check_ids, check_refs, investigation_report, metrics_report, run_summary, status_counts, tests_report,
)
from examples.tables import DIRTY_SQL, MISSING_SEGMENT, dirty_customer, table

CUSTOMER_SUITE = {
    "id": "customer_quality",
    "context": {"stream": "SALES", "project": "CRM", "zone": "raw"},
    "keys": {"customer": "c_custkey", "orders": "o_orderkey"},
    "metrics": {
        "segment_missing": {
            "type": "missing_rate", "specific": {"dataset": "customer", "column": "c_mktsegment"},
            "nature": {"name": "Segment missing", "description": "Customers without a segment"},
            "general": {"export": True, "owner": "crm"}},
        "balance_missing": {"type": "missing_rate", "specific": {"dataset": "customer", "column": "c_acctbal"}},
        "in_debt": {"type": "count_where", "specific": {"dataset": "customer", "filter": "c_acctbal < 0"}},
        "orders": {"type": "row_count", "specific": {"dataset": "orders"}},
        "broken": {"type": "missing_rate", "specific": {"dataset": "customer", "column": "no_such_column"}},
    },
    "tests": {
        "segment_filled": {
            "type": "interval_check", "specific": {
                "metric_id": "segment_missing", "target_mode": "metric_value", "lower_enabled": True,
                "lower_value": 0, "upper_enabled": True, "upper_value": 0.1},
            "nature": {"name": "Segment", "description": "At most a tenth of segments missing",
                       "functional_category_1": "Completeness"},
            "identification": {"control_id": "CRM_001"},
            "general": {"criticality": "high", "stop_on_failure": True}},
        "balance_filled": {"type": "range", "specific": {"metric_id": "balance_missing", "low": 0, "high": 0.5}},
        "nobody_in_debt": {"type": "threshold", "metric": "in_debt", "operator": "<=", "value": 0},
        "balance_bounds": {"type": "interval_check", "specific": {
            "target_mode": "dataset_columns", "database": "customer", "columns": ["c_acctbal"],
            "lower_enabled": True, "lower_value": -500, "upper_enabled": True, "upper_value": 9500}},
        "on_broken": {"type": "interval_check", "specific": {"metric_id": "broken", "upper": 1}},
        "price_positive": {"type": "interval_check", "specific": {
            "target_mode": "dataset_columns", "dataset": "orders", "columns": ["o_totalprice"],
            "lower": 0, "where": "o_orderstatus = 'F'"}},
    },
}


def _run(spark, sf, **options):
    datasets = {"customer": dirty_customer(spark, sf), "orders": table(spark, sf, "orders")}
    return run_suite(spark, datasets, CUSTOMER_SUITE, run_id="r1", **options)


def suite(spark, sf):
    """Metrics and tests of one run as one table."""
    result = _run(spark, sf, investigations=False)
    return result.metrics.select(
        F.lit("metric").alias("kind"), F.col("metric_id").alias("id"), F.round("value", 6).alias("value"), "status",
    ).unionByName(result.tests.select(
        F.lit("test").alias("kind"), F.col("test_id").alias("id"), F.round("value", 6).alias("value"), "status"))


def skip_propagation(spark, sf):
    """Tests of metrics that errored are skipped; the others of the same scan are not."""
    result = run_suite(spark, {"orders": table(spark, sf, "orders")}, {
        "metrics": [
            {"id": "divides", "type": "count_where", "filter": "1 / (o_orderkey - o_orderkey) > 0"},
            {"id": "unparsable", "type": "count_where", "filter": "o_totalprice >> > 1"},
            {"id": "unknown_type", "type": "median_rate"},
            {"id": "dear", "type": "count_where", "filter": "o_totalprice > 300000"}],
        "tests": [
            {"id": "t_divides", "type": "range", "metric": "divides", "low": 0, "high": 1},
            {"id": "t_unparsable", "type": "threshold", "metric": "unparsable", "value": 0},
            {"id": "t_unknown", "type": "interval_check", "metric": "unknown_type", "upper": 1},
            {"id": "t_dear", "type": "interval_check", "metric": "dear", "lower": 0}]})
    return result.tests.select("test_id", "value", "passed", "status")


def summary(spark, sf):
    return run_summary(_run(spark, sf)).select(
        "dq_id", "run_id", "total_metrics", "metrics_computed", "total_tests", "tests_passed",
        "tests_failed", "tests_errored", "tests_skipped", "status", "investigations", "investigation_report")


def counts_by_status(spark, sf):
    return status_counts(_run(spark, sf, investigations=False))


def report_of_metrics(spark, sf):
    report = metrics_report(_run(spark, sf, investigations=False), "2025-11-20 10:30:00")
    return report.withColumn("Value", F.round("Value", 6)).withColumn(
        "Timestamp", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"))


def report_of_tests(spark, sf):
    return tests_report(_run(spark, sf, investigations=False), {
        "project": "CRM", "user": "ana", "timestamp": "2025-11-20 10:30:00"})


def consolidate_results(spark, sf):
    customers = _run(spark, sf, investigations=False)
    lines = run_suite(spark, {"lineitem": table(spark, sf, "lineitem")}, {
        "metrics": [{"id": "orders", "type": "row_count"}],
        "tests": [{"id": "some", "type": "threshold", "metric": "orders", "operator": ">", "value": 0}]})
    merged = consolidate([("crm", customers), ("lines", lines)])
    return merged.metrics.select(F.col("metric_id").alias("id"), F.round("value", 6).alias("value"), "status").unionByName(
        merged.tests.select(F.col("test_id").alias("id"), F.round("value", 6).alias("value"), "status"))


def suite_id_check(spark, sf):
    """A catalog of suites, one per customer: its metrics from orders, its tests from their statuses."""
    orders = table(spark, sf, "orders")
    metrics = orders.selectExpr("o_custkey as suite_id", "'metric' as kind", "o_orderpriority as id")
    tests = orders.selectExpr(
        "o_custkey as suite_id", "'test' as kind",
        "case when o_totalprice > 400000 then o_orderpriority else concat(o_orderstatus, month(o_orderdate)) end as id")
    return check_ids(metrics.unionByName(tests))


def suite_ref_check(spark, sf):
    """Tests from order lines that name metrics (orders), datasets (brands) and columns (types)."""
    tests = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as suite_id", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as test_id",
        "case when l_linenumber <= 4 then concat('M', l_orderkey) end as metric_id",
        "case when l_linenumber = 5 then 'Brand#99' when l_linenumber > 5 then concat('Brand#', l_partkey % 30) end as dataset",
        "case when l_linenumber = 7 then if(l_partkey % 2 = 0, 'SMALL', 'HUGE') end as column")
    metrics = table(spark, sf, "lineitem").filter("l_linenumber <= 4 and l_quantity > 10").selectExpr(
        "l_suppkey as suite_id", "concat('M', l_orderkey) as metric_id")
    datasets = table(spark, sf, "part").selectExpr("p_brand as dataset", "p_type as column")
    return check_refs(tests, metrics, datasets)


def missing_rows(spark, sf):
    return investigate_missing(dirty_customer(spark, sf), ["c_mktsegment", "c_acctbal"], "c_custkey")


def matching_rows(spark, sf):
    return investigate_where(table(spark, sf, "orders"), "o_totalprice > 490000", "o_orderkey", 50).drop("o_orderdate")


def rows_out_of_bounds(spark, sf):
    return investigate_bounds(
        table(spark, sf, "customer"), {"c_acctbal": (0, 9000), "c_nationkey": (1, None)}, "c_custkey")


def duplicate_rows(spark, sf):
    return investigate_duplicates(
        table(spark, sf, "documents"), "text", "doc_id", 100, digest=True).select("doc_id", "lang", "n_chars")


def report_of_investigations(spark, sf):
    return investigation_report(_run(spark, sf)).select(
        "test_id", "test_type", "description", "dataset", "total_problematic_rows", "sample_size")


QUERIES = {
    "run_suite": suite, "skip_propagation": skip_propagation, "run_summary": summary,
    "status_counts": counts_by_status, "metrics_report": report_of_metrics,
    "tests_report": report_of_tests, "consolidate_results": consolidate_results,
    "suite_id_check": suite_id_check, "suite_ref_check": suite_ref_check,
    "investigate_missing": missing_rows, "investigate_where": matching_rows,
    "investigate_bounds": rows_out_of_bounds, "investigate_duplicates": duplicate_rows,
    "investigation_report": report_of_investigations,
}

_FIGURES = f"""
    with d as ({DIRTY_SQL}), c as (
        select count(*)::double as n, count(*) filter ({MISSING_SEGMENT})::double / count(*) as seg,
               count(*) filter (c_acctbal is null)::double / count(*) as bal,
               count(*) filter (c_acctbal < 0)::double as debt,
               count(*) filter (c_acctbal < -500 or c_acctbal > 9500)::double as bounds,
               count(c_acctbal) as balances from d),
    o as (select count(*)::double as n_orders, count(*) filter (o_orderstatus = 'F') as n_f,
                 count(*) filter (o_orderstatus = 'F' and o_totalprice < 0)::double as cheap from orders),
    m as (select 'segment_missing' as id, seg as value, 'SUCCESS' as status from c
          union all select 'balance_missing', bal, 'SUCCESS' from c
          union all select 'in_debt', debt, 'SUCCESS' from c
          union all select 'orders', n_orders, 'SUCCESS' from o
          union all select 'broken', null, 'ERROR'),
    t as (select 'segment_filled' as id, seg as value,
                 case when seg <= 0.1 then 'SUCCESS' else 'FAIL' end as status,
                 case when seg <= 0.1 then 'OK' else seg::varchar || ' > max 0.1' end as message from c
          union all select 'balance_filled', bal, case when bal <= 0.5 then 'SUCCESS' else 'FAIL' end,
                 case when bal <= 0.5 then 'OK' else 'value ' || bal::varchar || ' out of range [0.0, 0.5]' end from c
          union all select 'nobody_in_debt', debt, case when debt <= 0 then 'SUCCESS' else 'FAIL' end,
                 case when debt <= 0 then 'OK' else debt::varchar || ' is not <= 0.0' end from c
          union all select 'balance_bounds', bounds, case when bounds = 0 then 'SUCCESS' else 'FAIL' end,
                 case when bounds = 0 then 'All values (' || balances || ') respect the configured bounds.'
                 else bounds::bigint || '/' || balances || ' out of bounds in ''c_acctbal''' end from c
          union all select 'on_broken', null, 'SKIPPED',
                 'Metric ''broken'' is ERROR: no valid column for missing_rate among no_such_column'
          union all select 'price_positive', cheap, case when cheap = 0 then 'SUCCESS' else 'FAIL' end,
                 case when cheap = 0 then 'All values (' || n_f || ') respect the configured bounds.'
                 else cheap::bigint || '/' || n_f || ' out of bounds in ''o_totalprice''' end from o)"""

_IDS = """
    with s as (select o_custkey as suite_id, 'metric' as kind, o_orderpriority as id from orders
               union all select o_custkey, 'test',
                      case when o_totalprice > 400000 then o_orderpriority
                           else o_orderstatus || month(o_orderdate) end
               from orders),
         n as (select suite_id, id, count(*) filter (kind = 'metric') as m, count(*) filter (kind = 'test') as t
               from s group by all)"""

_REFS = """
    with tests as (
        select l_suppkey as suite_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey as test_id,
               case when l_linenumber <= 4 then 'M' || l_orderkey end as metric_id,
               case when l_linenumber = 5 then 'Brand#99'
                    when l_linenumber > 5 then 'Brand#' || (l_partkey % 30) end as dataset,
               case when l_linenumber = 7 then case when l_partkey % 2 = 0 then 'SMALL' else 'HUGE' end end as col
        from lineitem),
    metrics as (select distinct l_suppkey as suite_id, 'M' || l_orderkey as metric_id from lineitem
                where l_linenumber <= 4 and l_quantity > 10)"""

ORACLES = {
    "run_suite": _FIGURES + """
        select 'metric' as kind, id, round(value, 6) as value, status from m
        union all select 'test', id, round(value, 6), status from t""",
    "skip_propagation": """
        select 't_divides' as test_id, null::double as value, null::boolean as passed, 'SKIPPED' as status
        union all select 't_unparsable', null, null, 'SKIPPED'
        union all select 't_unknown', null, null, 'SKIPPED'
        union all select 't_dear', count(*) filter (o_totalprice > 300000)::double, true, 'SUCCESS' from orders""",
    "run_summary": _FIGURES + """
        select 'customer_quality' as dq_id, 'r1' as run_id, 5::bigint as total_metrics,
               (select count(*) from m where status = 'SUCCESS') as metrics_computed,
               count(*) as total_tests, count(*) filter (status = 'SUCCESS') as tests_passed,
               count(*) filter (status = 'FAIL') as tests_failed, 0::bigint as tests_errored,
               count(*) filter (status = 'SKIPPED') as tests_skipped, 'FAILED' as status,
               count(*) filter (status = 'FAIL') as investigations,
               case when count(*) filter (status = 'FAIL') > 0 then 'Yes' else 'No' end as investigation_report
        from t""",
    "status_counts": _FIGURES + """
        select 'metric' as kind, status, count(*) as n from m group by status
        union all select 'test', status, count(*) from t group by status""",
    "metrics_report": _FIGURES + """
        select id as "ID",
               case when id = 'in_debt' then 'count_where' when id = 'orders' then 'row_count' else 'missing_rate' end as "Type",
               case when id = 'segment_missing' then 'Segment missing' else '' end as "Name",
               case when id = 'segment_missing' then 'Customers without a segment' else '' end as "Description",
               '' as "Comments", true as "Export",
               case when id = 'segment_missing' then 'crm' else '' end as "Owner",
               case when id = 'orders' then 'orders' else 'customer' end as "Dataset",
               case id when 'segment_missing' then 'c_mktsegment' when 'balance_missing' then 'c_acctbal'
                       when 'broken' then 'no_such_column' else '' end as "Column",
               case when id = 'in_debt' then 'c_acctbal < 0' else '' end as "Filter",
               status as "Execution_Status", round(value, 6) as "Value",
               case when id = 'broken' then 'no valid column for missing_rate among no_such_column' else '' end as "Error",
               '2025-11-20 10:30:00' as "Timestamp"
        from m""",
    "tests_report": _FIGURES + """
        select 'Q4 2025' as quarter, 'CRM' as project, '20251120_103000' as run_version,
               case when id = 'segment_filled' then 'CRM_001' else id end as control_id,
               case when id = 'price_positive' then 'orders' else 'customer' end as dataset,
               case when id = 'segment_filled' then 'Completeness' else 'Business' end as category,
               case when id = 'segment_filled' then 'Yes' else 'No' end as blocking,
               status as execution_status,
               case status when 'SUCCESS' then 'PASS' else status end as result,
               case when id = 'segment_filled' then 'At most a tenth of segments missing' else '' end as description,
               '' as comments, case when status = 'SUCCESS' then '' else message end as error,
               'ana' as user, '2025-11-20 10:30:00' as timestamp
        from t""",
    "consolidate_results": _FIGURES + """
        select 'crm_' || id as id, round(value, 6) as value, status from m
        union all select 'crm_' || id, round(value, 6), status from t
        union all select 'lines_orders', count(*)::double, 'SUCCESS' from lineitem
        union all select 'lines_some', count(*)::double, 'SUCCESS' from lineitem""",
    "suite_id_check": _IDS + """
        select suite_id, id, 'duplicate metric' as problem, m as n from n where m > 1
        union all select suite_id, id, 'duplicate test', t from n where t > 1
        union all select suite_id, id, 'metric and test', m + t from n where m > 0 and t > 0""",
    "suite_ref_check": _REFS + """
        select t.suite_id, test_id, 'unknown metric' as problem, t.metric_id as reference
        from tests t anti join metrics m on t.suite_id = m.suite_id and t.metric_id = m.metric_id
        where t.metric_id is not null
        union all select suite_id, test_id, 'unknown dataset', dataset from tests
        where metric_id is null and dataset not in (select p_brand from part)
        union all select suite_id, test_id, 'unknown column', dataset || '.' || col from tests
        where metric_id is null and col is not null and dataset in (select p_brand from part)
          and not exists (select 1 from part where p_brand = dataset and p_type = col)""",
    "investigate_missing": f"""
        with d as ({DIRTY_SQL}) select * from d where {MISSING_SEGMENT} or c_acctbal is null
        order by c_custkey limit 100""",
    "investigate_where": """
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders
        where o_totalprice > 490000 order by o_orderkey limit 50""",
    "investigate_bounds": """
        select * from customer where c_acctbal < 0 or c_acctbal > 9000 or c_nationkey < 1
        order by c_custkey limit 100""",
    "investigate_duplicates": """
        select doc_id, lang, n_chars from documents
        where text in (select text from documents group by text having count(*) > 1) order by doc_id limit 100""",
    "investigation_report": _FIGURES + """,
        r as (
            select 'segment_filled' as test_id, 'interval_check' as test_type,
                   'Rows with missing values in c_mktsegment' as description, (seg * n)::bigint as bad from c where seg > 0.1
            union all select 'nobody_in_debt', 'threshold', 'Rows matching: c_acctbal < 0', debt::bigint from c where debt > 0
            union all select 'balance_bounds', 'interval_check', 'Values out of bounds: c_acctbal [-500.0, 9500.0]',
                   bounds::bigint from c where bounds > 0)
        select test_id, test_type, description, 'customer' as dataset, bad as total_problematic_rows,
               least(bad, 100) as sample_size from r""",
}
