"""Deliveries, inventory and definitions, made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions import local_frame
from dqspark.plans import (
    channel_stats, definition_stats, definition_values, filename_check, flatten_inventory,
    missing_files, process_delivery, recent, verdict, zone_counts,
)
from dqspark.sources import work_folder
from dqspark.streaming import watch_deliveries
from examples.tables import table


def missing_required_files(spark, sf):
    """Orders as submissions, priorities as channels, order lines as delivered files."""
    orders = table(spark, sf, "orders")
    spec = orders.select(F.col("o_orderpriority").alias("channel_id")).distinct().select(
        "channel_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("file_id"),
    ).select("channel_id", "file_id", F.concat(F.lit("file "), "file_id").alias("name"),
             (F.col("file_id") <= 2).alias("required"))
    submissions = orders.selectExpr("o_orderkey as submission_id", "o_orderpriority as channel_id")
    delivered = table(spark, sf, "lineitem").selectExpr("l_orderkey as submission_id", "l_linenumber as file_id")
    return missing_files(spec, submissions, delivered)


def filename_checks(spark, sf):
    documents = table(spark, sf, "documents")
    delivered = documents.selectExpr(
        "doc_id as submission_id", "source as channel_id", "lang as file_id",
        "concat(source, '_', doc_id, if(n_chars % 7 = 0, '.txt', '.csv')) as file_name")
    spec = documents.filter("lang <> 'de'").select("source", "lang").distinct().selectExpr(
        "source as channel_id", "lang as file_id",
        "case when lang = 'fr' then null else concat('^', source, '_[0-9]+[.]csv$') end as pattern")
    return filename_check(delivered, spec)


def submission_verdict(spark, sf):
    """Order lines as tests of their order."""
    tests = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as submission_id",
        "case when l_quantity = 50 and l_tax = 0 then 'ERROR' when l_quantity > 48 then 'FAIL' "
        "when l_discount = 0 then 'SKIPPED' else 'SUCCESS' end as status")
    overrides = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey as submission_id")
    return verdict(tests, overrides)


_STATUS = (
    "case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'dq_success' "
    "when 'signup' then case when event_id % 2 = 0 then 'rejected' else 'dq_failed' end else 'error' end")


def _submissions(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id as submission_id", "cast(user_id as string) as channel_id", f"{_STATUS} as status", "ts as submitted_at")


def channel_statistics(spark, sf):
    stats = channel_stats(_submissions(spark, sf))
    return stats.withColumn("success_rate", F.round("success_rate", 6))


def recent_submissions(spark, sf):
    of_all = recent(_submissions(spark, sf)).withColumn("asked", F.lit("all"))
    of_one = recent(_submissions(spark, sf), "8", 20).withColumn("asked", F.lit("one"))
    return of_all.unionByName(of_one).select("asked", "submission_id", "channel_id", "status")


def _inventory(spark, sf):
    """One stream per part, with a project of one zone that holds none to three datasets."""
    return table(spark, sf, "part").selectExpr(
        "concat('S', p_partkey % 1000) as id",
        """array(struct(p_brand as id, array(struct(
               concat('zone', p_partkey) as id,
               transform(filter(array(1, 2, 3), i -> i <= p_size % 4),
                         i -> struct(concat(p_name, ' ', i) as name, concat('a', i) as alias,
                                     concat('/data/', p_partkey, '/', i) as path)) as datasets)) as zones)) as projects""")


def inventory_rows(spark, sf):
    return flatten_inventory(_inventory(spark, sf))


def counts_per_zone(spark, sf):
    return zone_counts(flatten_inventory(_inventory(spark, sf)))


def _definitions(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('dq_', p_partkey) as id", "p_name as label", "p_brand as stream", "p_type as project",
        "if(p_size % 5 = 0, 'N/A', 'raw') as zone", "concat('2025Q', p_size % 4 + 1) as quarter",
        "array(concat('ds', p_partkey % 700), concat('ds', p_size)) as datasets",
        "p_size as metrics_count", "p_size % 3 as tests_count")


def definition_totals(spark, sf):
    everything = definition_stats(_definitions(spark, sf)).withColumn("asked", F.lit("all"))
    some = definition_stats(_definitions(spark, sf), "2025Q2", "RED").withColumn("asked", F.lit("red in Q2"))
    return everything.unionByName(some)


def definition_lists(spark, sf):
    return definition_values(_definitions(spark, sf), text="widget")


def delivery_run(spark, sf):
    """Two files of one channel, put through two suites and judged."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    folder = work_folder(spark, "delivery")
    customers.write.csv(f"{folder}/customers", header=True)
    orders.write.json(f"{folder}/orders")
    channel = {
        "channel_id": "crm",
        "files": [
            {"file_id": "customers", "name": "Customers", "format": "csv", "pattern": "^customers$",
             "schema": customers.schema, "schema_validation": True, "expected_columns": ["c_custkey"]},
            {"file_id": "orders", "name": "Orders", "format": "jsonl", "schema": orders.schema},
            {"file_id": "notes", "name": "Notes", "required": False}],
        "suites": [
            {"id": "balances",
             "metrics": [{"id": "in_debt", "type": "count_where", "dataset": "customers", "filter": "c_acctbal < 0"}],
             "tests": [{"id": "nobody", "type": "threshold", "metric": "in_debt", "operator": "<=", "value": 0}]},
            {"id": "keys", "tests": [{"id": "customers_known", "type": "foreign_key", "dataset": "orders",
                                      "column": "o_custkey", "ref": "customers.c_custkey"}]}]}
    done = process_delivery(spark, channel, "s1", {"customers": f"{folder}/customers", "orders": f"{folder}/orders"})
    return done.result.tests.select(
        F.lit(done.status).alias("delivery_status"), F.lit(done.accepted).alias("accepted"), "test_id", "value", "status")


def delivery_columns(spark, sf):
    """Three deliveries of one file: as declared, without a column, and with columns in another order."""
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand")
    folder = work_folder(spark, "columns")
    parts.write.csv(f"{folder}/whole", header=True)
    parts.drop("p_retailprice").write.csv(f"{folder}/lacking", header=True)
    parts.select("p_brand", "p_retailprice", "p_partkey").write.csv(f"{folder}/swapped", header=True)
    channel = {
        "channel_id": "parts",
        "files": [{"file_id": "part", "name": "Parts", "format": "csv", "schema": parts.schema,
                   "schema_validation": True, "expected_columns": parts.columns}],
        "suites": [{"id": "sums", "metrics": [
            {"id": "keys", "type": "sum", "dataset": "part", "column": "p_partkey"},
            {"id": "dearest", "type": "max", "dataset": "part", "column": "p_retailprice"}]}]}
    rows = None
    for name in ("whole", "lacking", "swapped"):
        done = process_delivery(spark, channel, name, {"part": f"{folder}/{name}"})
        found = local_frame(spark, [("error", None)], "metric_id string, value double") if done.result is None \
            else done.result.metrics.select("metric_id", "value")
        found = found.select(F.lit(name).alias("delivery"), F.lit(done.status).alias("status"), "metric_id", "value")
        rows = found if rows is None else rows.unionByName(found)
    return rows


INTAKE_SUITE = {
    "metrics": [
        {"id": "rows", "type": "row_count"},
        {"id": "dear", "type": "count_where", "filter": "o_totalprice > 400000"}],
    "tests": [{"id": "no_negative", "type": "interval_check", "columns": ["o_totalprice"], "lower": 0}],
}


def stream_intake(spark, sf):
    """Orders landing as CSV files, half of them while the query rests; its batches add up to the table."""
    orders = table(spark, sf, "orders")
    landing, sink = work_folder(spark, "landing"), work_folder(spark, "intake-results")
    for half in (0, 1):
        orders.filter(F.col("o_orderkey") % 2 == half).write.mode("append").csv(landing, header=True)
        query = watch_deliveries(
            spark, landing, INTAKE_SUITE, sink, schema=orders.schema, alias="orders", files_per_batch=1000,
            available_now=True)
        query.awaitTermination()
    metrics = spark.read.parquet(f"{sink}/metrics").groupBy(F.col("metric_id").alias("id")).agg(
        F.sum("value").alias("value"))
    tests = spark.read.parquet(f"{sink}/tests").groupBy(F.col("test_id").alias("id")).agg(
        F.sum("value").alias("value"))
    return metrics.unionByName(tests)


QUERIES = {
    "missing_files": missing_required_files, "filename_check": filename_checks,
    "submission_verdict": submission_verdict, "channel_stats": channel_statistics,
    "recent_submissions": recent_submissions, "flatten_inventory": inventory_rows,
    "zone_counts": counts_per_zone, "definition_stats": definition_totals,
    "definition_values": definition_lists, "delivery_run": delivery_run,
    "delivery_columns": delivery_columns, "stream_intake": stream_intake,
}

_ZONES = """
    with z as (select 'S' || (p_partkey % 1000) as stream, p_brand as project, 'zone' || p_partkey as zone,
                      p_name, p_partkey, p_size % 4 as n from part),
         d as (select stream, project, zone, p_name || ' ' || i as dataset, 'a' || i as alias,
                      '/data/' || p_partkey || '/' || i as source
               from z, (select unnest([1, 2, 3]) as i) where i <= n
               union all select stream, project, zone, '-', '-', null from z where n = 0)"""

_DEFINITIONS = """
    with d as (select 'dq_' || p_partkey as id, p_name as label, p_brand as stream, p_type as project,
                      case when p_size % 5 = 0 then 'N/A' else 'raw' end as zone,
                      '2025Q' || (p_size % 4 + 1) as quarter,
                      ['ds' || (p_partkey % 700), 'ds' || p_size] as datasets,
                      p_size as metrics_count, p_size % 3 as tests_count from part)"""


def _matching(text: str) -> str:
    return " or ".join(f"contains(lower({c}), '{text}')" for c in ("id", "label", "stream", "project"))


_TOTALS = """select count(*) as total_definitions, sum(metrics_count)::bigint as total_metrics,
    sum(tests_count)::bigint as total_tests, (select count(distinct x) from (
        select unnest(datasets) as x from {source})) as total_datasets, '{asked}' as asked from {source}"""

ORACLES = {
    "delivery_columns": """
        select delivery, 'DQ_SUCCESS' as status, metric_id, value from (values ('whole'), ('swapped')) d(delivery), (
            select 'keys' as metric_id, sum(p_partkey)::double as value from part
            union all select 'dearest', max(p_retailprice)::double from part)
        union all select 'lacking', 'ERROR', 'error', null""",
    "missing_files": """
        with e as (select o_orderkey as submission_id, o_orderpriority as channel_id, f as file_id
                   from orders, (select unnest([1, 2]) as f))
        select e.submission_id, e.channel_id, e.file_id, 'file ' || e.file_id as name
        from e anti join lineitem l on e.submission_id = l.l_orderkey and e.file_id = l.l_linenumber""",
    "filename_check": """
        with f as (select *, source || '_' || doc_id || case when n_chars % 7 = 0 then '.txt' else '.csv' end as file_name
                   from documents)
        select doc_id as submission_id, source as channel_id, lang as file_id, file_name,
               lang <> 'de' and (lang = 'fr' or regexp_matches(file_name, '^' || source || '_[0-9]+[.]csv$')) as passed,
               case when lang = 'de' then 'no specification'
                    when lang = 'fr' or regexp_matches(file_name, '^' || source || '_[0-9]+[.]csv$') then 'OK'
                    else 'name does not match' end as message
        from f""",
    "submission_verdict": """
        with t as (select l_orderkey as submission_id,
                   case when l_quantity = 50 and l_tax = 0 then 'ERROR' when l_quantity > 48 then 'FAIL'
                        when l_discount = 0 then 'SKIPPED' else 'SUCCESS' end as status from lineitem),
        c as (select submission_id, count(*) as dq_total, count(*) filter (status = 'SUCCESS') as dq_passed,
                     count(*) filter (status = 'FAIL') as dq_failed, count(*) filter (status = 'SKIPPED') as dq_skipped,
                     count(*) filter (status = 'ERROR') as dq_errors from t group by all),
        v as (select *, case when dq_errors > 0 then 'ERROR' when dq_failed > 0 then 'REJECTED'
                             when dq_skipped > 0 then 'DQ_FAILED' else 'DQ_SUCCESS' end as verdict from c)
        select *, verdict = 'DQ_SUCCESS' or submission_id in (
               select o_orderkey from orders where o_orderpriority = '1-URGENT') as accepted from v""",
    "channel_stats": f"""
        with s as (select cast(user_id as varchar) as channel_id, {_STATUS} as status from events)
        select channel_id, count(*) as total_submissions, count(*) filter (status = 'pending') as pending,
               count(*) filter (status = 'processing') as processing,
               count(*) filter (status = 'dq_success') as dq_success,
               count(*) filter (status = 'dq_failed') as dq_failed,
               count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'error') as error,
               round(count(*) filter (status = 'dq_success')::double / count(*) * 100, 6) as success_rate
        from s group by channel_id""",
    "recent_submissions": f"""
        with s as (select event_id as submission_id, cast(user_id as varchar) as channel_id, {_STATUS} as status, ts
                   from events)
        select 'all' as asked, submission_id, channel_id, status
        from (select * from s order by ts desc, submission_id limit 100)
        union all select 'one', submission_id, channel_id, status
        from (select * from s where channel_id = '8' order by ts desc, submission_id limit 20)""",
    "flatten_inventory": _ZONES + " select * from d",
    "zone_counts": _ZONES + """
        select stream, project, zone, count(*) filter (dataset <> '-') as datasets_count from d group by all""",
    "definition_stats": _DEFINITIONS
    + f", r as (select * from d where quarter = '2025Q2' and ({_matching('red')})) "
    + _TOTALS.format(source="d", asked="all") + " union all " + _TOTALS.format(source="r", asked="red in Q2"),
    "definition_values": _DEFINITIONS + f", w as (select * from d where {_matching('widget')}) " + " union all ".join(
        f"select '{c}' as field, {c} as value, count(*) as definitions from w where {c} <> 'N/A' group by {c}"
        for c in ("stream", "project", "zone", "quarter")),
    "delivery_run": """
        with t as (
            select 'balances_nobody' as test_id, count(*)::double as value from customer where c_acctbal < 0
            union all select 'keys_customers_known', count(*)::double
            from orders anti join customer on o_custkey = c_custkey)
        select case when max(value) over () > 0 then 'REJECTED' else 'DQ_SUCCESS' end as delivery_status,
               max(value) over () = 0 as accepted, test_id, value,
               case when value > 0 then 'FAIL' else 'SUCCESS' end as status from t""",
    "stream_intake": """
        select 'rows' as id, count(*)::double as value from orders
        union all select 'dear', count(*) filter (o_totalprice > 400000)::double from orders
        union all select 'no_negative', count(*) filter (o_totalprice < 0)::double from orders""",
}
