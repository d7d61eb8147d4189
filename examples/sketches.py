"""States that add up, values at ranks, frequent values."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import Metric
from dqspark.operators.frequent import frequent_values
from dqspark.operators.quantiles import exact_quantiles
from dqspark.operators.state import merge_states, shared_keys, store_states, stored_states
from dqspark.sources.readers import work_folder
from examples.tables import table

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

STATE_METRICS = [
    Metric("row_count", id="rows"), Metric("missing_rate", id="no_flag", column="l_returnflag"),
    Metric("sum", id="keys", column="l_orderkey"), Metric("min", id="first", column="l_shipdate"), Metric("max", id="dearest", column="l_extendedprice"),
    Metric("avg", id="quantity", column="l_quantity"), Metric("std", id="spread", column="l_quantity"),
    Metric("rule_share", id="cheap", filter="l_extendedprice < 10000", where="l_linestatus = 'O'"),
    Metric("count_out_of_range", id="tax", column="l_tax", low=0.01, high=0.05),
    Metric("unique_count", id="orders", column="l_orderkey", approx=True, sketch="hll"),
    Metric("unique_count", id="parts", column="l_partkey", approx=True, sketch="theta"),
    Metric("quantile", id="median", column="l_extendedprice"),
]
SKETCHED = {"orders": 0.08, "parts": 0.08}  # five times the sketches' standard error


def _stored(spark, sf):
    """Ten deliveries, each scanned once."""
    lines, path = table(spark, sf, "lineitem"), work_folder(spark, "states")
    for part in range(10):
        store_states(lines.where(F.col("l_orderkey") % 10 == part), STATE_METRICS, path, f"p{part}", {"half": part // 5})
    return lines, stored_states(spark, path)


def merged_states(spark, sf):
    """The states of ten parts put together; sketched counts as whether they are within their error of the exact ones."""
    lines, states = _stored(spark, sf)
    found = merge_states(states, STATE_METRICS, lines)
    true = lines.agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"),
                     F.count(F.lit(1)).alias("n"))
    true = true.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(m).alias("true")) for m in SKETCHED])))
    near = found.join(F.broadcast(true), "metric_id").select(
        "metric_id", (F.abs(F.col("value") - F.col("true")) <= F.col("true") * 0.08).cast("double").alias("value"), F.lit(None).cast("string").alias("exact"), "parts", "rows")
    exact = found.where(~F.col("metric_id").isin("median", *SKETCHED)).select("metric_id", F.round("value", 6).alias("value"), "exact", "parts", "rows")
    return exact.unionByName(near)


def merged_state_quantile(spark, sf):
    """The share of rows up to the median of merged sketches, which is a half but for the sketch's error."""
    lines, states = _stored(spark, sf)
    median = merge_states(states, STATE_METRICS, lines, by=["half"]).where("metric_id = 'median'").select("half", "value")
    halves = lines.select((F.col("l_orderkey") % 10 >= 5).cast("int").alias("half"), "l_extendedprice").join(F.broadcast(median), "half")
    return halves.groupBy("half").agg((F.abs(F.avg((F.col("l_extendedprice") <= F.col("value")).cast("double")) - 0.5) < 0.01).alias("near"))


def states_by_group(spark, sf):
    """Metrics of each half of the parts, from the same states."""
    lines, states = _stored(spark, sf)
    found = merge_states(states, STATE_METRICS[:9], lines, by=["half"])
    return found.select("half", "metric_id", F.round("value", 6).alias("value"), "exact")


def state_overlap(spark, sf):
    """Whether the parts' keys that the two halves share, from theta sketches, are within 8 % of what they are."""
    lines, states = _stored(spark, sf)
    found = shared_keys(states, STATE_METRICS[10], lines, "half").where("before is not null")
    true = lines.groupBy("l_partkey").agg(F.count_distinct(F.col("l_orderkey") % 10 >= 5).alias("halves")).agg(F.count_if(F.col("halves") == 2).alias("true"))
    return found.withColumn("one", F.lit(1)).join(F.broadcast(true.withColumn("one", F.lit(1))), "one").select(
        "half", "before", (F.abs(F.col("shared") - F.col("true")) <= F.col("true") * 0.08).alias("near"))


def exact_quantile(spark, sf):
    """Median and 99th percentile of every numeric column, as values of the table and interpolated."""
    lines = table(spark, sf, "lineitem").select(*NUMBERS)
    plain = exact_quantiles(lines, quantiles=(0.5, 0.99)).select(F.lit("value").alias("kind"), "column", "quantile", "value", "n")
    between = exact_quantiles(lines, quantiles=(0.5, 0.99), interpolate=True).select(F.lit("between").alias("kind"), "column", "quantile", "value", "n")
    return plain.unionByName(between).withColumn("value", F.round("value", 6))


SKEWED = "l_orderkey % (1 + l_partkey % 50)"


def frequent(spark, sf):
    """The twenty most frequent values of a skewed column, and of one where hardly any is frequent."""
    lines = table(spark, sf, "lineitem").select("l_partkey", F.expr(SKEWED).alias("skewed"))
    parts = [frequent_values(lines, c).select(F.lit(c).alias("column"), "value", "n", F.round("share", 8).alias("share")) for c in lines.columns]
    return parts[0].unionByName(parts[1])


QUERIES = {"merged_states": merged_states, "merged_state_quantile": merged_state_quantile, "states_by_group": states_by_group,
           "state_overlap": state_overlap, "exact_quantiles": exact_quantile, "frequent_values": frequent}

_NINE = """
    {key} 'rows' as metric_id, count(*)::double as value, cast(count(*) as varchar) as exact {more} from {t}
    union all {key} 'no_flag', round(count(*) filter (l_returnflag is null or trim(l_returnflag) = '')::double / count(*), 6), null {more} from {t}
    union all {key} 'keys', sum(l_orderkey)::double, cast(sum(l_orderkey) as varchar) {more} from {t}
    union all {key} 'first', null, {first} {more} from {t}
    union all {key} 'dearest', round(max(l_extendedprice), 6), null {more} from {t}
    union all {key} 'quantity', round(avg(l_quantity), 6), null {more} from {t}
    union all {key} 'spread', round(stddev_samp(l_quantity), 6), null {more} from {t}
    union all {key} 'cheap', round(count(*) filter (l_extendedprice < 10000 and l_linestatus = 'O')::double / count(*) filter (l_linestatus = 'O'), 6), null {more} from {t}
    union all {key} 'tax', count(*) filter (l_tax < 0.01 or l_tax > 0.05)::double, cast(count(*) filter (l_tax < 0.01 or l_tax > 0.05) as varchar) {more} from {t}"""
_FIRST = "strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "merged_states": _NINE.format(key="select", t="lineitem", first=_FIRST, more=", 10::bigint as parts, cast(count(*) as bigint) as rows")
    + " union all select unnest(['orders', 'parts']), 1.0, null, 10, count(*) from lineitem",
    "merged_state_quantile": "select unnest([0, 1]) as half, true as near",
    "states_by_group": "with h as (select *, cast(l_orderkey % 10 // 5 as integer) as half from lineitem) select * from ("
    + _NINE.format(key="select half,", t="h group by half", first=_FIRST, more="") + ")",
    "state_overlap": "select 1 as half, 0 as before, true as near",
    "exact_quantiles": " union all ".join(
        f"select '{kind}' as kind, '{c}' as column, {q}::double as quantile, round({fn}({c}, {q})::double, 6) as value, count({c}) as n from lineitem"
        for kind, fn in (("value", "quantile_disc"), ("between", "quantile_cont")) for c in NUMBERS for q in (0.5, 0.99)),
    "frequent_values": f"""
        with t as (select l_partkey, {SKEWED} as skewed from lineitem) """ + " union all ".join(
        f"(select '{c}' as column, {c} as value, count(*) as n, round(count(*)::double / (select count(*) from t), 8) as share from t "
        f"group by {c} order by n desc, value limit 20)" for c in ("l_partkey", "skewed")),
}
