"""Totals at all levels of some keys, and the difference of two deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import Metric
from dqspark.operators.difference import difference
from dqspark.operators.levels import metric_levels
from examples.tables import table

KEYS = ["o_orderstatus", "o_orderpriority", "year"]
METRICS = [Metric("row_count", id="rows"), Metric("sum", id="customers", column="o_custkey"), Metric("max", id="dearest", column="o_totalprice"),
           Metric("rule_share", id="dear", filter="o_totalprice > 200000", where="o_custkey % 2 = 0")]
# Orders with some of the statuses missing, so that a group of nulls stands beside the totals.
LEVEL_COLUMNS = (
    "case when o_orderkey % 9 = 0 then null else o_orderstatus end as o_orderstatus", "o_orderpriority",
    "cast(year(o_orderdate) as int) as year", "o_custkey", "o_totalprice")


def _levels(spark, sf, levels):
    orders = table(spark, sf, "orders").selectExpr(*LEVEL_COLUMNS)
    return metric_levels(orders, METRICS, KEYS, levels).select(*KEYS, "level", "metric_id", F.round("value", 6).alias("value"))


def levels_rollup(spark, sf):
    return _levels(spark, sf, "rollup")


def levels_cube(spark, sf):
    return _levels(spark, sf, "cube")


def levels_sets(spark, sf):
    """Two pairs of keys and the grand total."""
    return _levels(spark, sf, [["o_orderstatus", "year"], ["o_orderpriority", "year"], []])


# Two versions of a table: rows that come twice or three times, are gone, changed or new.
BEFORE = "select c_custkey, c_name, c_acctbal, c_mktsegment from customer union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 50 = 0"
AFTER = """
    select case when c_custkey % 97 = 5 then null else c_custkey end as c_custkey, c_name, case when c_custkey % 15 = 4 then c_acctbal + 1 else c_acctbal end as c_acctbal,
        case when c_custkey % 30 = 4 then null else c_mktsegment end as c_mktsegment
    from customer where c_custkey % 20 <> 3
    union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 100 = 0
    union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 100 = 0
    union all select c_custkey + 1000000, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 25 = 6"""


def delivery_difference(spark, sf):
    customer = table(spark, sf, "customer")
    before, after = (spark.sql(q.replace("from customer", "from {customer}"), customer=customer) for q in (BEFORE, AFTER))
    found = difference(before, after, "c_custkey")
    cells = [F.coalesce(F.col("before")[c], F.col("after")[c]).alias(c) for c in ("c_custkey", "c_name")]
    return found.select("kind", "n", *cells, F.col("before.c_acctbal").alias("old"), F.round("after.c_acctbal", 2).alias("new"),
                        F.array_join("changed", ",").alias("changed"))


QUERIES = {"levels_rollup": levels_rollup, "levels_cube": levels_cube, "levels_sets": levels_sets, "delivery_difference": delivery_difference}

_GROUPED = f"""
    with o as (select {', '.join(LEVEL_COLUMNS)} from orders),
    g as (
        select {', '.join(KEYS)}, cast(grouping({', '.join(KEYS)}) as integer) as level, count(*)::double as n, sum(o_custkey)::double as customers,
            max(o_totalprice) as dearest, coalesce(count(*) filter (o_totalprice > 200000 and o_custkey % 2 = 0)::double
                / nullif(count(*) filter (o_custkey % 2 = 0), 0), 0) as dear
        from o group by {{}})
    select {', '.join(KEYS)}, level, unnest(['rows', 'customers', 'dearest', 'dear']) as metric_id,
        round(unnest([n, customers, dearest, dear]), 6) as value from g"""

ORACLES = {
    "levels_rollup": _GROUPED.format(f"rollup ({', '.join(KEYS)})"),
    "levels_cube": _GROUPED.format(f"cube ({', '.join(KEYS)})"),
    "levels_sets": _GROUPED.format("grouping sets ((o_orderstatus, year), (o_orderpriority, year), ())"),
    "delivery_difference": f"""
        with u as (select *, -1 as side from ({BEFORE}) union all select *, 1 from ({AFTER})),
        net as (select c_custkey, c_name, c_acctbal, c_mktsegment, cast(sum(side) as bigint) as net from u group by all having sum(side) <> 0),
        k as (
            select c_custkey from net where c_custkey is not null group by c_custkey
            having coalesce(sum(-net) filter (net < 0), 0) = 1 and coalesce(sum(net) filter (net > 0), 0) = 1)
        select case when net < 0 then 'removed' else 'added' end as kind, abs(net) as n, c_custkey, c_name,
            case when net < 0 then c_acctbal end as old, case when net > 0 then round(c_acctbal, 2) end as new, null as changed
        from net where c_custkey is null or c_custkey not in (select c_custkey from k)
        union all
        select 'changed', 1, a.c_custkey, b.c_name, b.c_acctbal, round(a.c_acctbal, 2), concat_ws(',', case when a.c_name <> b.c_name then 'c_name' end,
            case when a.c_acctbal <> b.c_acctbal then 'c_acctbal' end, case when a.c_mktsegment is distinct from b.c_mktsegment then 'c_mktsegment' end)
        from net a join net b on a.c_custkey = b.c_custkey and a.net > 0 and b.net < 0 where a.c_custkey in (select c_custkey from k)""",
}
