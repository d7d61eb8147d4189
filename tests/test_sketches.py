"""States that add up, exact values at ranks, frequent values: against plain statements on random data."""

import math
import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dqspark import Metric, compute_metrics, run_suite
from dqspark.operators import quantiles
from dqspark.operators.frequent import candidates, frequent_values, merged_summaries, summary
from dqspark.operators.state import merge_states, metric_states, store_states, stored_states

SCHEMA = "id long, k long, d double, m decimal(20,3), t string"


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice([None, 2**60 + r.randint(0, 50), r.randint(-9, 9)]), r.choice([None, float("nan"), r.gauss(0, 1), 5.0]),
             Decimal(r.randint(-10**6, 10**6)).scaleb(-3) if i % 5 else None, r.choice(["1", " 2 ", "x", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


METRICS = [
    Metric("row_count", id="n"), Metric("null_rate", id="nulls"), Metric("sum", id="sum", column="k"), Metric("sum", id="money", column="m"),
    Metric("min", id="min", column="k"), Metric("max", id="max", column="m", where="k > 0"), Metric("count_where", id="some", filter="t = 'x'"),
    Metric("avg", id="avg", column="m"), Metric("std", id="std", column="d"), Metric("regex_share", id="digits", column="t", pattern="^ ?[0-9]"),
    Metric("unique_count", id="hll", column="id", approx=True, sketch="hll"), Metric("unique_count", id="theta", column="t", approx=True, sketch="theta"),
    Metric("quantile", id="q", column="d", q=0.25),
]


def test_parts_add_up_to_one_scan(spark):
    rows, df = table(spark, 400)
    parts = [metric_states(df.where(F.col("id") % 7 == p), METRICS, {"part": p}) for p in range(7)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    got = {r.metric_id: r for r in merge_states(states, METRICS, df.limit(0)).collect()}
    one = {r.metric_id: r for r in compute_metrics(df, METRICS, exact=True).collect()}
    for m in ("n", "nulls", "sum", "money", "min", "max", "some", "digits"):
        assert (got[m].value, got[m].exact) == (one[m].value, one[m].exact), m
    for m in ("avg", "std"):
        assert got[m].value == pytest.approx(one[m].value, rel=1e-9)
    assert abs(got["hll"].value - 400) < 30 and got["theta"].value == 3
    assert {(r.parts, r.rows) for r in got.values()} == {(7, 400)}


def test_stored_parts_are_replaced_and_may_lack_a_metric(spark, tmp_path):
    _, df = table(spark, 60)
    path, old, changed = str(tmp_path), METRICS[:3], Metric("sum", id="sum", column="k", where="k < 10")
    for part in (0, 1, 1):  # the second delivery comes again
        store_states(df.where(F.col("id") % 2 == part), old, path, f"p{part}")
    store_states(df.limit(0), [*old, METRICS[4], changed], path, "empty")
    got = {r.metric_id: r for r in merge_states(stored_states(spark, path), [*old[:2], METRICS[4], changed], df).collect()}
    assert got["n"].value == 60 and got["n"].parts == 3
    assert (got["min"].value, got["min"].parts, got["min"].rows) == (None, 1, 0) and got["sum"].parts == 1
    with pytest.raises(ValueError, match="none of"):
        merge_states(stored_states(spark, path), [METRICS[8]], df)


def test_what_has_no_state(spark):
    df = spark.createDataFrame([], SCHEMA)
    for m in (Metric("duplicate_count", id="d", columns=["k"]), Metric("unique_count", id="u", column="k", approx=True)):
        with pytest.raises(ValueError):
            metric_states(df, [m])


def ranked(values, q, interpolate):
    share, own = Fraction(str(q)), sorted(values)
    if not interpolate:
        return float(own[max(1, math.ceil(share * len(own))) - 1])
    place = share * (len(own) - 1)
    low, high = float(own[math.floor(place)]), float(own[math.ceil(place)])
    return low + (high - low) * float(place - math.floor(place))


@pytest.mark.parametrize("gathered", [1, 7, 10_000])
@pytest.mark.parametrize("interpolate", [False, True])
def test_quantiles_against_sorting(spark, monkeypatch, gathered, interpolate):
    monkeypatch.setattr(quantiles, "GATHERED", gathered)  # ranges are refined to the end, or fetched at once
    rows, df = table(spark, 300, gathered)
    own = {"k": [r[1] for r in rows if r[1] is not None], "d": [r[2] for r in rows if r[2] is not None and r[2] == r[2]],
           "m": [r[3] for r in rows if r[3] is not None], "t": [float(r[4]) for r in rows if r[4] in ("1", " 2 ")]}
    got = quantiles.exact_quantiles(df, list(own), [0, 0.1, 0.5, 0.99, 1], interpolate).collect()
    for r in got:
        want = ranked(own[r.column], r.quantile, interpolate)
        assert r.value == pytest.approx(want, rel=1e-12) and r.n == len(own[r.column]), r
        if not interpolate and r.column in "km":
            assert Decimal(r.exact) == sorted(own[r.column])[max(1, math.ceil(Fraction(str(r.quantile)) * r.n)) - 1]


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(7, None, 1.0, None, "x")] * 50, SCHEMA)
    got = {r.column: (r.value, r.n) for r in quantiles.exact_quantiles(df).collect()}
    assert got == {"id": (7.0, 50), "k": (None, 0), "d": (1.0, 50), "m": (None, 0)}
    assert quantiles.exact_quantiles(df.limit(0), ["id"], [0.5]).first().value is None


def test_quantile_metrics(spark):
    _, df = table(spark, 200)
    suite = {"metrics": [{"id": "near", "type": "quantile", "column": "id", "q": 0.9}, {"id": "exact", "type": "median", "column": "id", "exact": True, "where": "id >= 100"},
                         {"id": "bad", "type": "quantile", "column": "id", "q": 2}],
             "tests": [{"id": "t", "type": "interval_check", "metric_id": "exact", "upper": 149}]}
    result = run_suite(spark, {"d": df}, suite)
    got = {r.metric_id: (r.value, r.status) for r in result.metrics.collect()}
    assert abs(got["near"][0] - 179) <= 2 and got["exact"] == (149.0, "SUCCESS") and got["bad"][1] == "ERROR"
    assert result.tests.first().passed


@pytest.mark.parametrize("column", ["k", "d", "t"])
def test_frequent_values(spark, column):
    rows, df = table(spark, 500, 4)
    at = {"k": 1, "d": 2, "t": 4}[column]
    own = Counter(r[at] for r in rows if r[at] is not None and r[at] == r[at])
    want = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:6]
    assert [(r.value, r.n) for r in frequent_values(df, column, k=6).collect()] == want
    assert [(r.value, r.n) for r in frequent_values(df, column, k=6, tracked=8).collect()] == want


def test_frequent_values_of_even_and_empty_columns(spark, monkeypatch):
    from dqspark.operators import frequent
    monkeypatch.setattr(frequent, "MOST_TRACKED", 64)
    df = spark.range(3000).selectExpr("id", "id % 1500 as pair")
    assert [(r.value, r.n) for r in frequent_values(df, "pair", k=3, tracked=32).collect()] == [(0, 2), (1, 2), (2, 2)]
    assert frequent_values(df.limit(0), "id").count() == 0
    stored = df.groupBy((F.col("id") % 3).alias("g")).agg(summary(df, "pair", 10).alias("s"))
    assert candidates(merged_summaries(stored, "s"), "s", 5).columns == ["value", "about"]
