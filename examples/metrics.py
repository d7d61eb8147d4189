"""Metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import Metric, compute_metrics, metric, run_suite
from dqspark.operators import metric_details, metric_table
from examples.tables import (
    DATED_SQL, DIRTY_SQL, MISSING_SEGMENT, dated_orders, dirty_customer, table,
)


def _value(df, m: Metric, datasets=None):
    """One metric as (metric_id, value), rounded so that summation order does not show."""
    return compute_metrics(df, [m], datasets).select("metric_id", F.round("value", 6).alias("value"))


def missing_rate(spark, sf):
    return _value(dirty_customer(spark, sf), Metric("missing_rate", id="segment", column="c_mktsegment"))


def missing_rate_where(spark, sf):
    return _value(dirty_customer(spark, sf), Metric(
        "missing_rate", id="segment_in_credit", column="c_mktsegment", where="c_acctbal > 0"))


def missing_rate_wide(spark, sf):
    wide = metric_table(dirty_customer(spark, sf), Metric("missing_rate"))
    return wide.select(*[
        F.round(c, 6).alias(c) if c.endswith("_rate") else F.col(c) for c in wide.columns])


def missing_rate_overall(spark, sf):
    return _value(dirty_customer(spark, sf), Metric("missing_rate", id="overall"))


def null_rate(spark, sf):
    dirty = dirty_customer(spark, sf)
    return compute_metrics(dirty, [
        Metric("null_rate", id="segment", column="c_mktsegment"), Metric("null_rate", id="table"),
    ]).select("metric_id", F.round("value", 6).alias("value"))


def count_where(spark, sf):
    return _value(table(spark, sf, "orders"), Metric(
        "count_where", id="late_low", filter="o_orderpriority = '5-LOW' and not o_totalprice > 100000"))


def row_count(spark, sf):
    return _value(table(spark, sf, "lineitem"), Metric("row_count", id="rows"))


def row_count_by_group(spark, sf):
    return metric_table(table(spark, sf, "orders"), Metric(
        "row_count", group_by=["o_orderstatus", "o_orderpriority"]))


def unique_count(spark, sf):
    details = metric_details(table(spark, sf, "events"), Metric("unique_count", column="user_id"))
    return details.select(
        F.col("value").alias("unique_count"), "total_rows",
        F.round("uniqueness_rate", 6).alias("uniqueness_rate"))


def column_sum(spark, sf):
    details = metric_details(dirty_customer(spark, sf), Metric("column_sum", column="c_acctbal"))
    return details.select(F.round("value", 2).alias("total"), "non_null_count", "null_count")


def column_stats(spark, sf):
    return compute_metrics(dirty_customer(spark, sf), [
        Metric("stat", id=fn, column="c_acctbal", fn=fn) for fn in ("avg", "min", "max", "std")
    ]).select("metric_id", F.round("value", 4).alias("value"))


def duplicate_count(spark, sf):
    """Repeated texts, grouped by their digest so that no text is shuffled."""
    return metric_details(table(spark, sf, "documents"), Metric(
        "duplicate_count", columns=["text"], digest=True)).select(
        F.col("value").alias("duplicates"), "duplicated_keys", "rows_in_duplicates")


def aggregation_by_column(spark, sf):
    groups = metric_table(table(spark, sf, "orders"), Metric(
        "aggregation_by_column", group_by="o_orderstatus", target="o_totalprice"))
    return groups.select("o_orderstatus", "count", *[
        F.round(c, 2).alias(c) for c in groups.columns if c.endswith("_o_totalprice")])


def avg_completion_rate(spark, sf):
    return _value(dirty_customer(spark, sf), Metric("avg_completion_rate", id="completion"))


def table_shape(spark, sf):
    return metric_details(table(spark, sf, "lineitem"), Metric("table_shape")).select(
        "total_rows", "total_columns", "numeric_columns", F.round("shape_ratio", 2).alias("shape_ratio"))


def category_concentration(spark, sf):
    return compute_metrics(table(spark, sf, "documents"), [
        Metric("max_share", id="lang", column="lang"), Metric("max_share", id="source", column="source"),
    ]).select("metric_id", F.round("value", 6).alias("value"))


def negative_count(spark, sf):
    return _value(table(spark, sf, "supplier"), Metric("count_where", id="negative", filter="s_acctbal < 0"))


def out_of_range_count(spark, sf):
    df = table(spark, sf, "customer")
    return compute_metrics(df, [
        Metric("count_out_of_range", id="default", column="c_acctbal"),
        Metric("count_out_of_range", id="narrow", column="c_acctbal", low=500, high=9000)])


def cross_column_rule(spark, sf):
    return _value(table(spark, sf, "lineitem"), Metric(
        "count_where", id="untaxed", filter="l_quantity > 25 and l_tax <= 0"))


def arithmetic_coherence(spark, sf):
    priced = table(spark, sf, "lineitem").selectExpr(
        "l_quantity as quantity", "floor(l_extendedprice / l_quantity) as unit_price",
        "l_extendedprice as amount")
    return _value(priced, Metric(
        "rule_share", id="coherent", expr="abs(amount - quantity * unit_price) <= 10"))


def positive_share(spark, sf):
    return _value(dirty_customer(spark, sf), Metric("rule_share", id="positive", expr="c_acctbal > 0"))


def date_range_share(spark, sf):
    details = metric_details(dated_orders(spark, sf), Metric(
        "date_share", column="order_date", low="1996-01-01", high="1999-12-31", fmt="yyyy-MM-dd"))
    return details.select(F.round("value", 6).alias("value"), "valid", "unparseable")


def orphan_count(spark, sf):
    return compute_metrics(table(spark, sf, "documents"), [
        Metric("orphan_count", id="unlabelled", column="doc_id", ref="labels", ref_column="doc_id"),
    ], {"labels": table(spark, sf, "labels")}).unionByName(compute_metrics(table(spark, sf, "lineitem"), [
        Metric("orphan_count", id="orderless", column="l_orderkey", ref="orders", ref_column="o_orderkey"),
    ], {"orders": table(spark, sf, "orders")}))


def regex_share(spark, sf):
    return metric_details(table(spark, sf, "pages"), Metric(
        "regex_share", column="url", pattern=r"^https://[a-z.]+/(en|fr)/[0-9]+")).select(
        F.round("value", 6).alias("value"), "matches", "non_null")


# Twenty questions about one table; all but the last three share one scan.
BATCH = [
    Metric("row_count", id="rows"),
    Metric("missing_rate", id="missing_flag", column="l_returnflag"),
    Metric("missing_rate", id="missing_all"),
    Metric("null_rate", id="null_tax", column="l_tax"),
    Metric("avg_completion_rate", id="completion"),
    Metric("count_where", id="bulk", filter="l_quantity >= 45"),
    Metric("count_where", id="bulk_returned", filter="l_quantity >= 45", where="l_returnflag = 'R'"),
    Metric("count_out_of_range", id="price_range", column="l_extendedprice", low=1000, high=90000),
    Metric("rule_share", id="discounted", expr="l_discount > 0"),
    Metric("regex_share", id="flag_letter", column="l_returnflag", pattern="^[AN]$"),
    Metric("date_share", id="shipped_90s", column="l_shipdate", low="1995-01-01", high="1999-12-31"),
    Metric("column_sum", id="quantity", column="l_quantity"),
    Metric("avg", id="avg_price", column="l_extendedprice"),
    Metric("min", id="min_price", column="l_extendedprice"),
    Metric("max", id="max_price", column="l_extendedprice"),
    Metric("std", id="std_quantity", column="l_quantity"),
    Metric("table_shape", id="numeric_columns", measure="numeric_columns"),
    Metric("unique_count", id="orders", column="l_orderkey"),
    Metric("duplicate_count", id="repeated_orders", columns=["l_orderkey"]),
    Metric("max_share", id="top_flag", column="l_returnflag"),
]


def metric_batch(spark, sf):
    return compute_metrics(table(spark, sf, "lineitem"), BATCH).select(
        "metric_id", F.round("value", 4).alias("value"))


@metric("revenue", label="Revenue", group="Sales", params=("price", "discount"))
def _revenue(df, params):
    return F.sum(F.col(params["price"]) * (1 - F.col(params["discount"])))


@metric("revenue_by", label="Revenue per group", group="Sales", output={"flag": "string", "revenue": "float"})
def _revenue_by(df, params):
    return df.groupBy(F.col(params["by"]).alias("flag")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def custom_metric(spark, sf):
    """Two metrics of the user's own in a suite, and a test on the table one of them makes."""
    result = run_suite(spark, {"lineitem": table(spark, sf, "lineitem")}, {
        "metrics": [
            {"id": "revenue", "type": "revenue", "dataset": "lineitem", "price": "l_extendedprice",
             "discount": "l_discount", "where": "l_returnflag = 'R'"},
            {"id": "by_flag", "type": "revenue_by", "dataset": "lineitem", "by": "l_returnflag"}],
        "tests": [{"id": "each_flag_sells", "type": "interval_check", "dataset": "virtual:by_flag",
                   "columns": ["revenue"], "lower": 1}]})
    return result.metrics.select(F.col("metric_id").alias("id"), F.round("value", 2).alias("value")).unionByName(
        result.tests.select(F.col("test_id").alias("id"), "value"))


QUERIES = {
    "missing_rate": missing_rate, "missing_rate_where": missing_rate_where,
    "missing_rate_wide": missing_rate_wide, "missing_rate_overall": missing_rate_overall,
    "null_rate": null_rate, "count_where": count_where, "row_count": row_count,
    "row_count_by_group": row_count_by_group, "unique_count": unique_count,
    "column_sum": column_sum, "column_stats": column_stats, "duplicate_count": duplicate_count,
    "aggregation_by_column": aggregation_by_column, "avg_completion_rate": avg_completion_rate,
    "table_shape": table_shape, "category_concentration": category_concentration,
    "negative_count": negative_count, "out_of_range_count": out_of_range_count,
    "cross_column_rule": cross_column_rule, "arithmetic_coherence": arithmetic_coherence,
    "positive_share": positive_share, "date_range_share": date_range_share,
    "orphan_count": orphan_count, "regex_share": regex_share, "metric_batch": metric_batch,
    "custom_metric": custom_metric,
}

_RATE = "round(count(*) filter ({})::double / count(*), 6)"

ORACLES = {
    "missing_rate": f"""
        with d as ({DIRTY_SQL}) select 'segment' as metric_id, {_RATE.format(MISSING_SEGMENT)} as value from d""",
    "missing_rate_where": f"""
        with d as ({DIRTY_SQL}) select 'segment_in_credit' as metric_id,
               {_RATE.format(MISSING_SEGMENT)} as value from d where c_acctbal > 0""",
    "missing_rate_wide": f"""
        with d as ({DIRTY_SQL})
        select {_RATE.format("c_custkey is null")} as c_custkey_missing_rate,
               count(*) filter (c_custkey is null) as c_custkey_missing_number,
               {_RATE.format(MISSING_SEGMENT)} as c_mktsegment_missing_rate,
               count(*) filter ({MISSING_SEGMENT}) as c_mktsegment_missing_number,
               {_RATE.format("c_acctbal is null")} as c_acctbal_missing_rate,
               count(*) filter (c_acctbal is null) as c_acctbal_missing_number
        from d""",
    "missing_rate_overall": f"""
        with d as ({DIRTY_SQL})
        select 'overall' as metric_id, round((count(*) filter (c_custkey is null)
               + count(*) filter ({MISSING_SEGMENT}) + count(*) filter (c_acctbal is null))::double
               / (3 * count(*)), 6) as value from d""",
    "null_rate": f"""
        with d as ({DIRTY_SQL})
        select 'segment' as metric_id, {_RATE.format("c_mktsegment is null")} as value from d
        union all select 'table', round((count(*) filter (c_custkey is null)
               + count(*) filter (c_mktsegment is null) + count(*) filter (c_acctbal is null))::double
               / (3 * count(*)), 6) from d""",
    "count_where": """
        select 'late_low' as metric_id, count(*)::double as value from orders
        where o_orderpriority = '5-LOW' and not o_totalprice > 100000""",
    "row_count": "select 'rows' as metric_id, count(*)::double as value from lineitem",
    "row_count_by_group": """
        select o_orderstatus, o_orderpriority, count(*) as row_count from orders group by all""",
    "unique_count": """
        select count(distinct user_id) as unique_count, count(*) as total_rows,
               round(count(distinct user_id)::double / count(*), 6) as uniqueness_rate from events""",
    "column_sum": f"""
        with d as ({DIRTY_SQL})
        select round(sum(c_acctbal), 2) as total, count(c_acctbal) as non_null_count,
               count(*) - count(c_acctbal) as null_count from d""",
    "column_stats": f"""
        with d as ({DIRTY_SQL})
        select 'avg' as metric_id, round(avg(c_acctbal), 4) as value from d
        union all select 'min', round(min(c_acctbal), 4) from d
        union all select 'max', round(max(c_acctbal), 4) from d
        union all select 'std', round(stddev_samp(c_acctbal), 4) from d""",
    "duplicate_count": """
        with k as (select text, count(*) as n from documents group by text)
        select sum(n - 1)::bigint as duplicates, count(*) filter (n > 1) as duplicated_keys,
               coalesce(sum(n) filter (n > 1), 0)::bigint as rows_in_duplicates from k""",
    "aggregation_by_column": """
        select o_orderstatus, count(*) as count, round(sum(o_totalprice), 2) as sum_o_totalprice,
               round(avg(o_totalprice), 2) as avg_o_totalprice, round(min(o_totalprice), 2) as min_o_totalprice,
               round(max(o_totalprice), 2) as max_o_totalprice
        from orders group by o_orderstatus""",
    "avg_completion_rate": f"""
        with d as ({DIRTY_SQL})
        select 'completion' as metric_id, round((count(c_custkey) + count(c_mktsegment) + count(c_acctbal))::double
               / (3 * count(*)), 6) as value from d""",
    "table_shape": """
        select count(*) as total_rows, 11::bigint as total_columns, 8::bigint as numeric_columns,
               round(count(*)::double / 11, 2) as shape_ratio from lineitem""",
    "category_concentration": """
        select 'lang' as metric_id, round(max(n)::double / sum(n), 6) as value
        from (select lang, count(*) as n from documents where lang is not null group by lang)
        union all select 'source', round(max(n)::double / sum(n), 6)
        from (select source, count(*) as n from documents where source is not null group by source)""",
    "negative_count": "select 'negative' as metric_id, count(*)::double as value from supplier where s_acctbal < 0",
    "out_of_range_count": """
        select 'default' as metric_id, count(*)::double as value from customer
        where c_acctbal < 0.01 or c_acctbal > 1000000
        union all select 'narrow', count(*)::double from customer where c_acctbal < 500 or c_acctbal > 9000""",
    "cross_column_rule": """
        select 'untaxed' as metric_id, count(*)::double as value from lineitem where l_quantity > 25 and l_tax <= 0""",
    "arithmetic_coherence": """
        select 'coherent' as metric_id, round(count(*) filter (
               abs(l_extendedprice - l_quantity * floor(l_extendedprice / l_quantity)) <= 10)::double / count(*), 6)
               as value from lineitem""",
    "positive_share": f"""
        with d as ({DIRTY_SQL})
        select 'positive' as metric_id, {_RATE.format("c_acctbal > 0")} as value from d""",
    "date_range_share": f"""
        with d as ({DATED_SQL}), p as (select try_cast(order_date as date) as day from d)
        select {_RATE.format("day between date '1996-01-01' and date '1999-12-31'")} as value,
               count(*) filter (day between date '1996-01-01' and date '1999-12-31') as valid,
               count(*) filter (day is null) as unparseable from p""",
    "orphan_count": """
        select 'unlabelled' as metric_id, count(*)::double as value
        from documents d anti join labels l on d.doc_id = l.doc_id
        union all select 'orderless', count(*)::double
        from lineitem anti join orders on l_orderkey = o_orderkey""",
    "regex_share": r"""
        select round(count(*) filter (regexp_matches(url, '^https://[a-z.]+/(en|fr)/[0-9]+'))::double
               / count(url), 6) as value,
               count(*) filter (regexp_matches(url, '^https://[a-z.]+/(en|fr)/[0-9]+')) as matches,
               count(url) as non_null from pages""",
    "metric_batch": """
        with k as (select count(*) as n from lineitem group by l_orderkey),
             f as (select count(*) as n from lineitem group by l_returnflag)
        select 'rows' as metric_id, count(*)::double as value from lineitem
        union all select 'missing_flag', round(count(*) filter (l_returnflag is null or trim(l_returnflag) = '')
            ::double / count(*), 4) from lineitem
        union all select 'missing_all', 0.0
        union all select 'null_tax', round(count(*) filter (l_tax is null)::double / count(*), 4) from lineitem
        union all select 'completion', 1.0
        union all select 'bulk', count(*)::double from lineitem where l_quantity >= 45
        union all select 'bulk_returned', count(*)::double from lineitem where l_quantity >= 45 and l_returnflag = 'R'
        union all select 'price_range', count(*)::double from lineitem
            where l_extendedprice < 1000 or l_extendedprice > 90000
        union all select 'discounted', round(count(*) filter (l_discount > 0)::double / count(*), 4) from lineitem
        union all select 'flag_letter', round(count(*) filter (regexp_matches(l_returnflag, '^[AN]$'))::double
            / count(l_returnflag), 4) from lineitem
        union all select 'shipped_90s', round(count(*) filter (l_shipdate >= date '1995-01-01'
            and l_shipdate < date '2000-01-01')::double / count(*), 4) from lineitem
        union all select 'quantity', round(sum(l_quantity), 4) from lineitem
        union all select 'avg_price', round(avg(l_extendedprice), 4) from lineitem
        union all select 'min_price', round(min(l_extendedprice), 4) from lineitem
        union all select 'max_price', round(max(l_extendedprice), 4) from lineitem
        union all select 'std_quantity', round(stddev_samp(l_quantity), 4) from lineitem
        union all select 'numeric_columns', 8.0
        union all select 'orders', count(*)::double from k
        union all select 'repeated_orders', sum(n - 1)::double from k
        union all select 'top_flag', round(max(n)::double / sum(n), 4) from f""",
    "custom_metric": """
        select 'revenue' as id, round(sum(l_extendedprice * (1 - l_discount)), 2) as value
        from lineitem where l_returnflag = 'R'
        union all select 'by_flag', count(distinct l_returnflag)::double from lineitem
        union all select 'each_flag_sells', count(*) filter (revenue < 1)::double from (
            select sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem group by l_returnflag)""",
}
