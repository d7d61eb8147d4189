"""Bounds, sums and extremes beyond what a double holds."""

from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dqspark import Metric, compute_metrics, run_suite
from dqspark.functions.exact import Bound, breaks
from dqspark.operators import interval_check_columns

BIG = 2**53


def test_a_bound_keeps_what_was_written():
    assert Bound(BIG + 1).exact == BIG + 1 and Bound(str(BIG + 1)).exact == BIG + 1
    assert Bound(0.1).exact == Decimal("0.1") and Bound(Bound("0.30")).exact == Decimal("0.30")
    assert Bound(Decimal("1.05")) == 1.05 and Bound(float("inf")).exact.is_infinite() and Bound(True).exact == 1


@pytest.mark.parametrize("kind,values", [
    ("bigint", [BIG, BIG + 1, BIG + 2, -BIG - 1, 0, 2**63 - 1, -2**63, None]),
    ("int", [0, 1, -1, 2**31 - 1, None]),
    ("decimal(38,2)", ["90071992547409.93", "90071992547409.92", "0.10", "-0.01", "0", None]),
    ("decimal(20,0)", [str(BIG + 1), "99999999999999999999", "-1", None]),
])
@pytest.mark.parametrize("inclusive", [True, False])
def test_against_fractions(spark, kind, values, inclusive):
    df = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "i int, v string").select("i", F.col("v").cast(kind).alias("v"))
    limits = [BIG, BIG + 1, str(BIG + 1), 0.1, "0.1", -1, 0, 0.5, -0.005, "90071992547409.925", 1e30, -1e30, 10**40, float("inf"), float("-inf")]
    columns = [breaks(df, "v", b, None, inclusive).alias(f"low{i}") for i, b in enumerate(limits)]
    columns += [breaks(df, "v", None, b, inclusive).alias(f"high{i}") for i, b in enumerate(limits)]
    for row in df.select("i", *columns).collect():
        value = values[row.i]
        for i, b in enumerate(limits):
            if value is None:
                assert not row[f"low{i}"] and not row[f"high{i}"]
                continue
            own, exact = Fraction(str(value)), Bound(b).exact
            if exact.is_infinite():
                below, above, same = exact > 0, exact < 0, False
            else:
                below, above, same = own < Fraction(exact), own > Fraction(exact), own == Fraction(exact)
            assert row[f"low{i}"] == (below or (same and not inclusive)), (value, b)
            assert row[f"high{i}"] == (above or (same and not inclusive)), (value, b)


def test_metrics_beside_the_double(spark):
    df = spark.createDataFrame([(BIG + 1, Decimal("0.10"), "2024-02-29"), (5, Decimal("99999999999999.99"), "2023-01-01"), (None, None, None)],
                               "k long, p decimal(16,2), d string").withColumn("d", F.col("d").cast("date"))
    asked = [Metric(fn, id=f"{fn} {c}", column=c) for fn, c in (("max", "k"), ("sum", "k"), ("sum", "p"), ("min", "d"), ("avg", "k"))]
    got = {r.metric_id: (r.value, r.exact) for r in compute_metrics(df, asked, exact=True).collect()}
    assert got["max k"] == (float(BIG), str(BIG + 1)) and got["sum k"][1] == str(BIG + 6)
    assert got["sum p"][1] == "100000000000000.09" and got["min d"] == (None, "2023-01-01") and got["avg k"][1] is None


def test_sums_beyond_a_bigint(spark):
    df = spark.range(3).select(F.lit(2**63 - 1).alias("k"))
    assert compute_metrics(df, [Metric("sum", id="s", column="k")], exact=True).first().exact == str(3 * (2**63 - 1))
    assert compute_metrics(df.limit(0), [Metric("sum", id="s", column="k")], exact=True).first().value == 0.0


def test_verdicts(spark):
    df = spark.createDataFrame([(BIG + 1, 1)], "k long, id long")
    assert interval_check_columns(df, ["k"], upper=BIG).first().passed is False
    assert interval_check_columns(df, ["k"], upper=BIG + 1).first().passed is True
    result = run_suite(spark, {"t": df}, {
        "keys": {"t": "id"}, "metrics": [{"id": "most", "type": "max", "column": "k"}, {"id": "out", "type": "count_out_of_range", "column": "k", "high": BIG}],
        "tests": [{"id": "metric", "type": "interval_check", "metric_id": "most", "upper": BIG},
                  {"id": "column", "type": "interval_check", "columns": ["k"], "upper": BIG},
                  {"id": "none out", "type": "threshold", "metric": "out", "operator": "=", "value": 0}]})
    got = {r.test_id: r for r in result.tests.collect()}
    assert {t: r.status for t, r in got.items()} == dict.fromkeys(("metric", "column", "none out"), "FAIL")
    assert got["metric"].message == f"{BIG + 1} > max {BIG}"
    assert result.samples["column"].count() == result.samples["none out"].count() == 1
    assert {r.metric_id: r.exact for r in result.metrics.collect()} == {"most": str(BIG + 1), "out": "1"}
