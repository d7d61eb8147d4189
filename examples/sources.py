"""Reading, sampling, registering and writing datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from dqspark import DatasetRegistry, Metric, run_suite
from dqspark.functions import apply_value_filter, check_value_filter, local_frame, value_filter_prechecks
from dqspark.operators import compute_metrics, investigate_where, metric_table
from dqspark.sources import load, preview, sample, schema_table, work_folder, write_results, write_sample
from examples.tables import DIRTY_SQL, dirty_customer, table

# A lookup a user would hold in memory.
PRIORITY_DAYS = {"1-URGENT": 1, "2-HIGH": 3, "3-MEDIUM": 7, "4-NOT SPECIFIED": 14, "5-LOW": 30}


def scan_parquet(spark, sf):
    df = load(spark, f"{sf}/orders.parquet")
    return df.filter("o_totalprice > 400000").select("o_orderkey", "o_orderstatus", "o_totalprice")


def scan_fallback(spark, sf):
    path = work_folder(spark, "mislabelled") + ".parquet"
    table(spark, sf, "customer").write.csv(path, header=True)
    df = load(spark, path)
    return df.select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), "c_acctbal")


def scan_csv(spark, sf):
    parts = table(spark, sf, "part")
    path = work_folder(spark, "part")
    parts.write.csv(path, header=True, sep=";")
    return load(spark, path, "csv", schema=parts.schema, options={"sep": ";", "encoding": "UTF-8"})


def scan_tsv(spark, sf):
    suppliers = table(spark, sf, "supplier")
    path = work_folder(spark, "supplier")
    suppliers.write.csv(path, header=True, sep="\t")
    return load(spark, path, "tsv", schema=suppliers.schema)


def scan_json(spark, sf):
    orders = table(spark, sf, "orders").drop("o_orderdate")
    path = work_folder(spark, "orders")
    orders.write.json(path)
    return load(spark, path, "jsonl", schema=orders.schema)


def scan_table(spark, sf):
    path = work_folder(spark, "labels")
    table(spark, sf, "labels").write.mode("overwrite").option("path", path).saveAsTable("dq_labels")
    return load(spark, table="dq_labels")


def scan_memory(spark, sf):
    days = load(spark, frame=pd.DataFrame({
        "o_orderpriority": list(PRIORITY_DAYS), "days": list(PRIORITY_DAYS.values())}))
    orders = table(spark, sf, "orders")
    return orders.join(days, "o_orderpriority").groupBy("o_orderpriority", "days").agg(
        F.count(F.lit(1)).alias("orders"))


def scan_query(spark, sf):
    DatasetRegistry(spark, {"dq_orders": f"{sf}/orders.parquet"}).create_views()
    return load(spark, query=(
        "select o_orderstatus, count(*) as orders, max(o_totalprice) as highest "
        "from dq_orders where o_orderdate >= timestamp_ntz'1998-01-01' group by o_orderstatus"))


def sample_head(spark, sf):
    return sample(table(spark, sf, "events"), "head", 500, ["event_id", "event_type", "value"], "event_id")


def sample_random(spark, sf):
    return sample(table(spark, sf, "events"), "random", 500, ["event_id", "event_type"], "event_id", seed=7)


def scan_parquet_full(spark, sf):
    return load(spark, f"{sf}/orders.parquet")


def scan_json_array(spark, sf):
    """Each file one array of records, as other tools write them."""
    parts = table(spark, sf, "supplier")
    path = work_folder(spark, "array")
    records = parts.groupBy(F.pmod(F.xxhash64("s_suppkey"), F.lit(4)).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*parts.columns))).alias("value"))
    records.write.partitionBy("file").text(path)
    return load(spark, path, "json", schema=parts.schema).drop("file")


def scan_one_array(spark, sf):
    """All orders as one array in one file, each with an object, a list and a text full of brackets, read by many tasks."""
    orders = table(spark, sf, "orders")
    quoted = F.concat(F.lit('} "{'), "o_orderpriority", F.lit('\\"],['))
    record = F.struct("o_orderkey", F.struct("o_orderstatus", F.struct("o_custkey").alias("of")).alias("state"),
                      F.array("o_totalprice").alias("prices"), quoted.alias("note"))
    lines = orders.select(F.concat(F.lit(","), F.to_json(record)).alias("value"))
    ends = [spark.createDataFrame([(text,)], "value string") for text in ("[{}", "]")]
    path = work_folder(spark, "one-array")
    ends[0].union(lines).union(ends[1]).coalesce(1).write.text(path)
    found = load(spark, path, "json_array", schema=(
        "o_orderkey bigint, state struct<o_orderstatus: string, of: struct<o_custkey: bigint>>, prices array<double>, note string"))
    return found.where("o_orderkey is not null").select(
        "o_orderkey", "state.o_orderstatus", "state.of.o_custkey", F.col("prices")[0].alias("o_totalprice"), "note")


def sink_samples(spark, sf):
    """Every table of a run read back: the samples are as long as the reports say."""
    suite = {**RESULT_SUITE, "keys": {"customer": "c_custkey"}, "globals": {"sample_size": 3000}, "tests": [
        {"id": "script_free", "type": "threshold", "metric": "negative", "operator": "<=", "value": 0},
        {"id": "named", "type": "interval_check", "metric_id": "segment_missing", "upper": 0}]}
    paths = write_results(run_suite(spark, {"customer": dirty_customer(spark, sf)}, suite, run_id="r1"),
                          work_folder(spark, "results"))
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    rows = read["samples"].groupBy("run_id", "test_id").agg(F.count(F.lit(1)).alias("rows"))
    return read["tests"].select("run_id", "test_id", "status").join(
        read["investigations"].select("test_id", "total_problematic_rows", "sample_size"), "test_id").join(
        rows, ["run_id", "test_id"])


def profile_schema(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    filled = compute_metrics(lineitem, [
        Metric("count_where", id=c, filter=f"{c} is not null") for c in lineitem.columns])
    return schema_table(lineitem).join(
        filled.withColumnRenamed("metric_id", "column"), "column"
    ).select("position", "column", "type", F.col("value").cast("bigint").alias("filled"))


def first_rows(spark, sf):
    return preview(table(spark, sf, "part"), 10, "p_partkey")


def registry_lookup(spark, sf):
    names = ("orders", "lineitem", "customer")
    registry = DatasetRegistry(
        spark,
        [{"alias": n, "name": f"{n} table", "source": {"kind": "local", "path": f"{sf}/{n}.parquet"}}
         for n in names],
        overrides={"customer": f"{sf}/supplier.parquet"})
    lookups = {"by alias": "orders", "by name": "lineitem table",
               "by path": f"{sf}/orders.parquet", "overridden": "customer"}
    counts = [
        registry[name].agg(F.lit(how).alias("lookup"), F.count(F.lit(1)).alias("row_count"))
        for how, name in lookups.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def virtual_dataset(spark, sf):
    registry = DatasetRegistry(spark, {"customer": dirty_customer(spark, sf)})
    output = metric_table(registry["customer"], Metric("missing_rate", columns=["c_mktsegment", "c_acctbal"]))
    alias = registry.add_virtual("M-001", output)
    if registry.check_refs(alias, ["c_mktsegment_missing_rate"]):
        raise ValueError("the virtual dataset lacks its column")
    return registry[alias].select(
        "c_mktsegment_missing_number", F.round("c_mktsegment_missing_rate", 6).alias("c_mktsegment_missing_rate"),
        "c_acctbal_missing_number", F.round("c_acctbal_missing_rate", 6).alias("c_acctbal_missing_rate"))


def sink_csv(spark, sf):
    rows = investigate_where(table(spark, sf, "customer"), "c_acctbal < 0", "c_custkey", 100)
    path = write_sample(rows, work_folder(spark, "samples"), "balances", "negative", "run1")
    return load(spark, path, "csv", schema=rows.schema)


RESULT_SUITE = {
    "id": "balances", "keys": {"customer": "c_custkey"},
    "metrics": [
        {"id": "rows", "type": "row_count", "dataset": "customer"},
        {"id": "segment_missing", "type": "missing_rate", "dataset": "customer", "column": "c_mktsegment"},
        {"id": "negative", "type": "count_where", "dataset": "customer", "filter": "c_acctbal < 0"},
    ],
    "tests": [{"id": "few_missing", "type": "interval_check", "metric_id": "segment_missing", "upper": 0.1}],
}


def sink_results(spark, sf):
    result = run_suite(spark, {"customer": dirty_customer(spark, sf)}, RESULT_SUITE, run_id="r1")
    paths = write_results(result, work_folder(spark, "results"))
    return spark.read.parquet(paths["metrics"]).select(
        "run_id", "suite_id", "metric_id", "status", F.round("value", 6).alias("value"))


URGENT_FILTER = {
    "conditions": [
        {"column": "o_orderpriority", "type": "S", "value": "1-URGENT", "result": True},
        {"column": "o_orderstatus", "type": "S", "value": "F", "result": False},
        {"column": "o_orderpriority", "type": "S", "value": "2-HIGH", "result": True},
    ],
    "default": False,
}
BROKEN_FILTER = {
    "conditions": [
        {"column": "o_totalprice", "type": "S", "value": "10", "result": True},
        {"column": "region", "type": "S", "value": "North", "result": True},
    ],
    "default": False,
}


def value_filter(spark, sf):
    kept = apply_value_filter(table(spark, sf, "orders"), URGENT_FILTER)
    return kept.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


def value_filter_check(spark, sf):
    """Problems per filter, and what a usable one keeps."""
    orders = table(spark, sf, "orders")
    rows = [("urgent", p) for p in check_value_filter(orders.schema, URGENT_FILTER) or ["OK"]]
    rows += [("broken", p) for p in check_value_filter(orders.schema, BROKEN_FILTER) or ["OK"]]
    kept = apply_value_filter(orders, URGENT_FILTER).agg(F.count(F.lit(1)).alias("rows_kept"))
    problems = local_frame(spark, rows, "filter_name string, problem string")
    return problems.join(kept.withColumn("problem", F.lit("OK")), "problem", "left").select(
        "filter_name", "problem", "rows_kept")


def filter_prechecks(spark, sf):
    """Precheck rows of both filters beside the metric they let through or block."""
    orders = table(spark, sf, "orders")
    parts = []
    for name, spec in (("urgent", URGENT_FILTER), ("broken", BROKEN_FILTER)):
        rows, _ = value_filter_prechecks(spark, name, orders.schema, spec, stream="sales", zone="raw")
        parts.append(rows)
    suite = {"metrics": [
        {"id": name, "type": "row_count", "dataset": "orders", "value_filter": spec}
        for name, spec in (("urgent", URGENT_FILTER), ("broken", BROKEN_FILTER))]}
    metrics = run_suite(spark, {"orders": orders}, suite).metrics.select(
        F.col("metric_id").alias("filter_name"), F.col("status").alias("metric_status"),
        F.col("value").alias("rows_kept"))
    return parts[0].unionByName(parts[1]).join(metrics, "filter_name").select(
        "control_id", "filter_name", "column", "type_code", "result", "metric_status", "rows_kept")


QUERIES = {
    "scan_parquet": scan_parquet, "scan_fallback": scan_fallback, "scan_csv": scan_csv,
    "scan_tsv": scan_tsv, "scan_json": scan_json, "scan_table": scan_table,
    "scan_memory": scan_memory, "scan_query": scan_query, "sample_head": sample_head,
    "sample_random": sample_random, "schema_table": profile_schema, "preview": first_rows,
    "registry_lookup": registry_lookup, "virtual_dataset": virtual_dataset, "sink_csv": sink_csv,
    "sink_results": sink_results, "sink_samples": sink_samples, "scan_parquet_full": scan_parquet_full,
    "scan_json_array": scan_json_array, "scan_one_array": scan_one_array, "value_filter": value_filter,
    "value_filter_check": value_filter_check, "value_filter_prechecks": filter_prechecks,
}

_LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}

_KEPT = """case when o_orderpriority = '1-URGENT' then true when o_orderstatus = 'F' then false
                when o_orderpriority = '2-HIGH' then true else false end"""

ORACLES = {
    "scan_parquet": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 400000",
    "scan_fallback": "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal from customer",
    "scan_csv": "select * from part",
    "scan_parquet_full": "select * from orders",
    "scan_json_array": "select * from supplier",
    "scan_one_array": """
        select o_orderkey, o_orderstatus, o_custkey, o_totalprice, '} "{' || o_orderpriority || chr(92) || '"],[' as note
        from orders where o_orderkey is not null""",
    "sample_random": """
        select event_id, event_type from events order by md5('7|' || cast(event_id as varchar)), event_id limit 500""",
    "sink_samples": f"""
        with d as ({DIRTY_SQL}),
        n as (select count(*) filter (c_acctbal < 0) as negative,
                     count(*) filter (c_mktsegment is null or trim(c_mktsegment) = '') as missing from d)
        select 'r1' as run_id, 'script_free' as test_id, 'FAIL' as status, negative as total_problematic_rows,
               least(negative, 3000) as sample_size, least(negative, 3000) as rows from n
        union all select 'r1', 'named', 'FAIL', missing, least(missing, 3000), least(missing, 3000) from n""",
    "scan_tsv": "select * from supplier",
    "scan_json": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
    "scan_table": "select * from labels",
    "scan_memory": """
        select o_orderpriority, cast(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 3
               when '3-MEDIUM' then 7 when '4-NOT SPECIFIED' then 14 else 30 end as bigint) as days,
               count(*) as orders
        from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
        group by all""",
    "scan_query": """
        select o_orderstatus, count(*) as orders, max(o_totalprice) as highest
        from orders where o_orderdate >= timestamp '1998-01-01' group by o_orderstatus""",
    "sample_head": "select event_id, event_type, value from events order by event_id limit 500",
    "schema_table": " union all ".join(
        f"select {i}::int as position, '{c}' as \"column\", '{t}' as type, count({c}) as filled from lineitem"
        for i, (c, t) in enumerate(_LINEITEM_TYPES.items())),
    "preview": "select * from part order by p_partkey limit 10",
    "registry_lookup": """
        select 'by alias' as lookup, count(*) as row_count from orders
        union all select 'by name', count(*) from lineitem
        union all select 'by path', count(*) from orders
        union all select 'overridden', count(*) from supplier""",
    "virtual_dataset": f"""
        with d as ({DIRTY_SQL})
        select count(*) filter (c_mktsegment is null or trim(c_mktsegment) = '') as c_mktsegment_missing_number,
               round(count(*) filter (c_mktsegment is null or trim(c_mktsegment) = '')::double / count(*), 6)
                   as c_mktsegment_missing_rate,
               count(*) filter (c_acctbal is null) as c_acctbal_missing_number,
               round(count(*) filter (c_acctbal is null)::double / count(*), 6) as c_acctbal_missing_rate
        from d""",
    "sink_csv": "select * from customer where c_acctbal < 0 order by c_custkey limit 100",
    "sink_results": f"""
        with d as ({DIRTY_SQL})
        select 'r1' as run_id, 'balances' as suite_id, 'rows' as metric_id, 'SUCCESS' as status,
               count(*)::double as value from d
        union all select 'r1', 'balances', 'segment_missing', 'SUCCESS',
               round(count(*) filter (c_mktsegment is null or trim(c_mktsegment) = '')::double / count(*), 6) from d
        union all select 'r1', 'balances', 'negative', 'SUCCESS', count(*) filter (c_acctbal < 0)::double from d""",
    "value_filter": f"""
        select o_orderpriority, o_orderstatus, count(*) as orders from orders where {_KEPT} group by all""",
    "value_filter_check": f"""
        select 'urgent' as filter_name, 'OK' as problem, count(*) as rows_kept from orders where {_KEPT}
        union all select 'broken', 'type of ''o_totalprice'' does not fit: expected S, found double', null
        union all select 'broken', 'column ''region'' is not in the dataset', null""",
    "value_filter_prechecks": f"""
        with kept as (select count(*)::double as n from orders where {_KEPT})
        select 'SAL_RAW_T-001' as control_id, 'urgent' as filter_name, 'o_orderpriority' as "column",
               'S' as type_code, 'Pass' as result, 'SUCCESS' as metric_status, n as rows_kept from kept
        union all select 'SAL_RAW_T-002', 'urgent', 'o_orderstatus', 'S', 'Pass', 'SUCCESS', n from kept
        union all select 'SAL_RAW_T-003', 'urgent', 'o_orderpriority', 'S', 'Pass', 'SUCCESS', n from kept
        union all select 'SAL_RAW_T-004', 'urgent', null, null, 'Pass', 'SUCCESS', n from kept
        union all select 'SAL_RAW_T-001', 'broken', 'o_totalprice', 'S', 'Fail', 'BLOCKED', null
        union all select 'SAL_RAW_T-002', 'broken', 'region', 'S', 'Fail', 'BLOCKED', null
        union all select 'SAL_RAW_T-003', 'broken', null, null, 'Fail', 'BLOCKED', null""",
}
