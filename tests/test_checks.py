import math

import pytest
from conftest import rows

from dqspark.functions import local_frame
from dqspark.operators import (
    assert_output_schema, columns_present, columns_typed, interval_check_columns, metric_checks,
    metric_tests, range_columns, regex_check, resolve_bounds,
)
from dqspark.plans.result import METRICS_SCHEMA


@pytest.fixture(scope="module")
def amounts(spark):
    return spark.createDataFrame([(12.0, 11), (15.5, 15), (25.0, 5), (60.0, 18)], "amount double, quantity int")


def judge(spark, value, status="SUCCESS", error=None, **test):
    metrics = local_frame(spark, [("s", "m", "t", "ds", "c", value, status, error)], METRICS_SCHEMA)
    test = {"id": "t", "metric_id": "m", "type": "interval_check", **test}
    return rows(metric_checks(metric_tests(spark, [test]), metrics))[0]


def test_interval_on_metric_values(spark):
    assert judge(spark, 0.52, lower=0.5, upper=0.8)["message"] == "OK"
    high = judge(spark, 1.4, lower=0.2, upper=1.0)
    assert (high["passed"], high["status"], high["message"]) == (False, "FAIL", "1.4 > max 1.0")
    assert judge(spark, 0.1, lower=0.2, upper=1.0)["message"] == "0.1 < min 0.2"
    assert judge(spark, 0.5, lower=0.5, upper=0.5)["passed"] is True
    assert judge(spark, 0.0, upper=0)["passed"] is True
    both = judge(spark, 5, lower=9, upper=1)
    assert both["message"] == "5.0 < min 9.0; 5.0 > max 1.0"


def test_tests_that_cannot_be_judged(spark):
    assert judge(spark, 1.0)["message"].startswith("Define at least one bound")
    assert "not found" in judge(spark, 1.0, metric_id="other", upper=1)["message"]
    assert judge(spark, 1.0, metric_id="", upper=1)["passed"] is False
    skipped = judge(spark, None, "ERROR", "no such column", upper=1)
    assert (skipped["passed"], skipped["status"]) == (None, "SKIPPED")
    assert skipped["message"] == "Metric 'm' is ERROR: no such column"
    assert judge(spark, None, upper=1)["status"] == "FAIL"
    assert judge(spark, math.nan, upper=1)["status"] == "FAIL"


def test_range_inclusive_exclusive_and_incomparable(spark):
    assert judge(spark, 5, type="range", lower=5, upper=10)["passed"] is True
    open_end = judge(spark, 5, type="range", lower=5, upper=10, inclusive=False)
    assert open_end["message"] == "value 5.0 out of range (5.0, 10.0)"
    assert judge(spark, 6, type="range", lower=5, upper=10, inclusive=False)["passed"] is True
    assert judge(spark, 11, type="range", lower=5, upper=10)["message"] == "value 11.0 out of range [5.0, 10.0]"
    assert judge(spark, 5, type="range", lower="a", upper=10)["message"].startswith("Incomparable types")


@pytest.mark.parametrize("op,passed", [
    ("=", False), ("==", False), ("!=", True), (">=", True), ("<=", False), (">", True), ("<", False)])
def test_threshold_operators(spark, op, passed):
    assert judge(spark, 3, type="threshold", op=op, target=2)["passed"] is passed


def test_threshold_mistakes(spark):
    assert judge(spark, 3, type="threshold", op="~", target=2)["message"] == "Unknown operator '~'."
    assert judge(spark, 3, type="threshold", op=">")["status"] == "FAIL"
    assert judge(spark, 12345678.5, type="threshold", op="<", target=0.00025)["message"] == (
        "12345678.5 is not < 0.00025")


def test_column_bounds(spark, amounts):
    found = rows(interval_check_columns(amounts, ["amount", "quantity"], 10, 50))[0]
    assert (found["value"], found["passed"]) == (2.0, False)
    assert found["message"] == "1/4 out of bounds in 'amount'; 1/4 out of bounds in 'quantity'"
    ruled = interval_check_columns(amounts, ["amount"], 10, 50, [
        {"columns": ["amount"], "upper": 30}, {"columns": ["quantity"], "lower": 10, "upper": 17}])
    assert rows(ruled)[0]["value"] == 3.0
    fine = rows(interval_check_columns(amounts, ["amount"], 0, 100))[0]
    assert fine["message"] == "All values (4) respect the configured bounds."


def test_rules_replace_bounds_and_the_last_wins():
    bounds = resolve_bounds(["a", "b"], 0, 9, [
        {"columns": ["a"], "lower": 1}, {"columns": ["a", "c"], "lower_value": 2, "upper_value": 3}])
    assert bounds == {"a": (2.0, 3.0), "b": (0.0, 9.0), "c": (2.0, 3.0)}


def test_columns_that_cannot_be_checked_fail(spark):
    df = spark.createDataFrame([("x", None, 1.0, "7"), ("y", None, math.nan, "12d")],
                               "t string, n double, d double, num string")
    found = rows(interval_check_columns(df, ["t", "n", "gone", "d", "num"], upper=100, column_rules=[
        {"columns": ["d"]}]))[0]
    assert found["passed"] is False
    assert found["message"] == (
        "Missing columns: gone; Columns without numeric values: n, t; No bounds configured for: d")
    only_missing = rows(interval_check_columns(df, ["gone"], upper=1))[0]
    assert (only_missing["passed"], only_missing["message"]) == (False, "Missing columns: gone")
    with pytest.raises(ValueError):
        interval_check_columns(df, [], 0, 1)
    with pytest.raises(ValueError):
        interval_check_columns(df, ["d"])


def test_nan_breaks_no_bound(spark):
    df = spark.createDataFrame([(math.nan,), (5.0,)], "v double")
    counts = rows(interval_check_columns(df, ["v"], upper=10, per_column=True))[0]
    assert (counts["checked"], counts["violations"]) == (1, 0)


def test_exclusive_columns_and_where(spark, amounts):
    assert rows(range_columns(amounts, ["quantity"], 5, 18, inclusive=False))[0]["value"] == 2.0
    assert rows(range_columns(amounts, ["quantity"], 5, 18))[0]["passed"] is True
    assert rows(interval_check_columns(amounts, ["amount"], upper=20, where="quantity < 12"))[0]["value"] == 1.0


def test_regex(spark):
    df = spark.createDataFrame([("AB1",), ("x",), (None,)], "code string")
    found = rows(regex_check(df, "code", "^[A-Z]{2}[0-9]$"))[0]
    assert (found["passed"], found["message"]) == (False, "1/2 not matching in 'code'")
    empty = spark.createDataFrame([], "code string")
    assert rows(regex_check(empty, "code"))[0]["passed"] is True


def test_schema_checks_run_nothing(spark, amounts):
    present = rows(columns_present(amounts, ["amount", "gone"]))
    assert [r["passed"] for r in present] == [True, False]
    typed = rows(columns_typed(amounts, {"amount": "N", "quantity": "i", "gone": "S"}))
    assert [r["passed"] for r in typed] == [True, True, False]
    assert rows(columns_typed(amounts, {"amount": "I"}))[0]["message"] == "'amount' is double, expected I"
    facts = rows(assert_output_schema(amounts, {"amount": "float", "total": "int"}), "column")
    assert [(r["column"], r["passed"]) for r in facts] == [("amount", True), ("quantity", False), ("total", False)]


def test_plan_reads_only_the_checked_columns(spark, tmp_path, amounts):
    amounts.write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    plan = interval_check_columns(df, ["quantity"], 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<quantity:int>" in plan


def test_random_bounds_against_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    texts = np.array(["5", " 7.5 ", "-1e2", "abc", "", "1_000", "inf", "NaN", None], dtype=object)
    for n in (1, 60, 500):
        pdf = pd.DataFrame({"t": rng.choice(texts, n), "d": rng.choice([1.0, -3.5, np.nan, 250.0], n),
                            "i": rng.integers(-5, 5, n)})
        df = spark.createDataFrame([(r.t, float(r.d), int(r.i)) for r in pdf.itertuples()], "t string, d double, i bigint")
        for low, high in ((0, 10), (None, 3), (-100, None)):
            found = {r["column"]: r for r in interval_check_columns(
                df, ["t", "d", "i"], low, high, per_column=True).collect()}
            for c in ("t", "d", "i"):
                values = pd.to_numeric(pdf[c], errors="coerce").dropna()
                bad = pd.Series(False, index=values.index)
                if low is not None:
                    bad |= values < low
                if high is not None:
                    bad |= values > high
                assert (found[c]["checked"], found[c]["violations"]) == (len(values), bad.sum())
