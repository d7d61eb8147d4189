import datetime
import math

import pytest
from conftest import rows

from dqspark import Metric, compute_metrics, run_suite
from dqspark.operators import declared_output, metric_details, metric_table, orphan_count


def value(df, type_name, datasets=None, **params):
    return compute_metrics(df, [Metric(type_name, id="m", **params)], datasets).first()["value"]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("2024-01-01", "North", 100.0, 10), ("2024-01-02", "South", 200.0, 20),
         ("2024-01-03", "North", None, 15), ("2024-01-04", "East", 150.0, 25)],
        "date string, region string, amount double, quantity int")


@pytest.fixture(scope="module")
def payments(spark):
    return spark.createDataFrame(
        [("T001", 100.5, "2025-11-01"), ("T002", -50.0, "2025/11/02"), ("T003", 1500000.0, "2025-11-03"),
         ("T004", 250.75, "invalid_date"), ("T002", 100.0, None)],
        "transaction_id string, amount double, date string")


def test_missing_rate_per_column_and_over_the_table(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 2.0)], "a double, b double")
    assert value(df, "missing_rate", column="a") == pytest.approx(1 / 3)
    assert value(df, "missing_rate", column="b") == pytest.approx(2 / 3)
    assert value(df, "missing_rate") == pytest.approx(0.5)
    assert value(df, "missing_rate", columns=["b", "nope", "b"]) == pytest.approx(2 / 3)


def test_missing_counts_nan_and_blank_text_but_null_rate_only_nan(spark):
    df = spark.createDataFrame(
        [("", 1.0), ("   ", math.nan), ("\t", None), (None, 4.0), ("x", 5.0)], "s string, d double")
    assert value(df, "missing_rate", column="s") == pytest.approx(3 / 5)
    assert value(df, "null_rate", column="s") == pytest.approx(1 / 5)
    assert value(df, "missing_rate", column="d") == value(df, "null_rate", column="d") == pytest.approx(2 / 5)
    assert value(df, "null_rate") == pytest.approx(3 / 10)


def test_empty_tables_have_zero_rates(spark):
    df = spark.createDataFrame([], "a string, b double")
    for name in ("missing_rate", "null_rate", "avg_completion_rate"):
        assert value(df, name) == 0.0
    assert value(df, "column_sum", column="b") == 0.0
    assert value(df, "unique_count", column="a") == 0.0
    assert value(df, "duplicate_count", columns=["a"]) == 0.0
    assert value(df, "max_share", column="a") == 0.0
    assert value(df, "regex_share", column="a") == 0.0


def test_unknown_columns_are_refused(spark, sales):
    with pytest.raises(ValueError):
        value(sales, "missing_rate", column="nope")
    with pytest.raises(KeyError):
        value(sales, "unique_count", column="nope")
    with pytest.raises(ValueError):
        value(sales, "count_where", filter="  ")
    with pytest.raises(ValueError):
        value(sales, "no_such_metric")


def test_sales_rates_and_wide_row(spark, sales):
    assert value(sales, "missing_rate", column="amount") == 0.25
    assert value(sales, "missing_rate") == 0.0625
    wide = metric_table(sales, Metric("missing_rate", columns=["amount", "region"]))
    assert wide.columns == [
        "amount_missing_rate", "amount_missing_number", "region_missing_rate", "region_missing_number"]
    assert tuple(wide.first()) == (0.25, 1, 0.0, 0)


def test_aggregation_by_column(spark, sales):
    m = Metric("aggregation_by_column", group_by="region", target="amount")
    made = metric_table(sales, m)
    assert set(declared_output(m, sales)) == set(made.columns)
    north = made.filter("region = 'North'").first()
    assert (north["count"], north["sum_amount"], north["avg_amount"]) == (2, 100.0, 100.0)
    groups = metric_table(sales, Metric("row_count", group_by=["region"]))
    assert {r["region"]: r["row_count"] for r in groups.collect()} == {"North": 2, "South": 1, "East": 1}


def test_where_scopes_a_metric_inside_a_shared_scan(spark, sales):
    got = compute_metrics(sales, [
        Metric("row_count", id="all"), Metric("row_count", id="north", where="region = 'North'"),
        Metric("missing_rate", id="north_missing", column="amount", where="region = 'North'"),
        Metric("max", id="south_max", column="quantity", where="region = 'South'"),
        Metric("unique_count", id="north_regions", column="region", where="region = 'North'"),
    ])
    assert {r["metric_id"]: r["value"] for r in got.collect()} == {
        "all": 4, "north": 2, "north_missing": 0.5, "south_max": 20, "north_regions": 1}


def test_a_condition_all_metrics_share_reaches_the_scan(spark, tmp_path, sales):
    sales.write.parquet(str(tmp_path / "sales"))
    df = spark.read.parquet(str(tmp_path / "sales"))
    plan = compute_metrics(df, [
        Metric("row_count", id="a", where="region = 'North'"),
        Metric("sum", id="b", column="amount", where="region = 'North'")],
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,North)" in plan


def test_business_counts(spark, payments):
    assert value(payments, "count_where", filter="amount < 0") == 1
    assert value(payments, "count_out_of_range", column="amount") == 2
    assert value(payments, "duplicate_count", columns=["transaction_id"]) == 1
    assert value(payments, "row_count") == 5
    # three-valued logic: a null condition is no match, so only 2025-11-01 counts
    assert value(payments, "count_where", filter="not date > '2025-11-02'") == 1


def test_duplicates_count_nulls_as_one_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2)], "k string, v int")
    assert value(df, "duplicate_count", columns=["k"]) == 2
    assert value(df, "duplicate_count", columns=["k", "v"]) == 1
    assert value(df, "duplicate_count", columns=["k"], digest=True) == 2
    details = metric_details(df, Metric("duplicate_count", columns=["k"])).first()
    assert (details["duplicated_keys"], details["rows_in_duplicates"]) == (2, 4)


def test_unique_sum_and_statistics_ignore_missing(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", math.nan), ("b", None), (None, 5.0)], "k string, v double")
    unique = metric_details(df, Metric("unique_count", column="k")).first()
    assert (unique["value"], unique["total_rows"], unique["uniqueness_rate"]) == (2, 4, 0.5)
    assert value(df, "nunique", column="v") == 2
    assert value(df, "unique_count", column="k", approx=True) == 2
    total = metric_details(df, Metric("column_sum", column="v")).first()
    assert (total["value"], total["non_null_count"], total["null_count"]) == (6.0, 2, 2)
    assert value(df, "avg", column="v") == 3.0
    assert value(df, "stat", column="v", fn="std") == pytest.approx(math.sqrt(8))
    assert value(df, "max_share", column="k") == pytest.approx(2 / 3)


def test_statistics_read_numeric_text(spark):
    df = spark.createDataFrame([("12",), (" 3 ",), ("1e1",), ("12d",), ("1,000",), ("x",), ("",)], "v string")
    assert value(df, "sum", column="v") == 25.0
    assert value(df, "max", column="v") == 12.0


def test_completion_and_shape(spark):
    df = spark.createDataFrame(
        [(1, "Alice", 10.5, "A"), (2, "Bob", 20.3, "B"), (3, None, 30.1, "A"), (4, "David", None, "C"),
         (5, "Eve", 50.9, None)], "id int, name string, value double, category string")
    assert value(df, "avg_completion_rate") == pytest.approx(0.85)
    shape = metric_details(df, Metric("table_shape")).first()
    assert (shape["total_rows"], shape["total_columns"], shape["numeric_columns"]) == (5, 4, 2)
    assert shape["shape_ratio"] == 1.25


def test_rules_patterns_and_dates(spark, payments):
    assert value(payments, "rule_share", expr="amount between 0 and 1000") == pytest.approx(3 / 5)
    mails = spark.createDataFrame([("a@b.org",), ("a@b",), (None,), ("no",)], "mail string")
    assert value(mails, "regex_share", column="mail") == pytest.approx(1 / 3)
    dates = metric_details(payments, Metric(
        "date_share", column="date", low="2025-11-02", high="2025-11-30", fmt="yyyy-MM-dd")).first()
    assert (dates["value"], dates["valid"], dates["unparseable"]) == (0.2, 1, 3)
    stamps = spark.createDataFrame(
        [(datetime.datetime(2024, 12, 31, 23, 0),), (datetime.datetime(2025, 1, 1),)], "t timestamp_ntz")
    assert value(stamps, "date_share", column="t", low="2024-01-01", high="2024-12-31") == 0.5
    assert value(stamps, "date_share", column="t", high="2024-12-31 22:00:00") == 0.0


def test_orphans_ignore_null_keys_and_repeats(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "r int")
    found = orphan_count(left, "k", right, "r").first()
    assert (found["value"], found["orphan_keys"]) == (2, 1)
    assert value(left, "orphan_count", {"ref": right}, column="k", ref="ref", ref_column="r") == 2


def test_generated_customers(spark):
    people = spark.range(50).selectExpr(
        "id", "if(id % 5 = 0, null, concat('Name ', id)) as name", "if(id % 7 = 0, null, concat(id, '@x.fr')) as email",
        "if(id % 10 = 0, -1, 30) as age")
    # every 7th of 0..49 is 8 rows
    got = {r["metric_id"]: r["value"] for r in compute_metrics(people, [
        Metric("missing_rate", id="name", column="name"), Metric("missing_rate", id="email", column="email"),
        Metric("count_where", id="age", filter="age < 0")]).collect()}
    assert got == {"name": 0.2, "email": 0.16, "age": 5}


def test_column_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "`a.b` int, `c``d` string")
    assert value(df, "missing_rate", column="a.b") == 0.5
    assert value(df, "unique_count", column="c`d") == 1
    wide = metric_table(df, Metric("missing_rate"))
    assert wide.columns[0] == "a.b_missing_rate"


def test_random_tables_against_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    for n in (1, 37, 400):
        pdf = pd.DataFrame({
            "s": rng.choice(["a", "b", "", " ", "12", "x1", None], n), "d": rng.choice([1.5, -2.0, np.nan, 7.0], n),
            "k": rng.integers(0, 9, n)})
        df = spark.createDataFrame(
            [(None if r.s is None or r.s is np.nan else r.s, float(r.d), int(r.k)) for r in pdf.itertuples()],
            "s string, d double, k bigint")
        blank = pdf["s"].isna() | (pdf["s"].fillna("x").str.strip(" ") == "")
        got = {r["metric_id"]: r["value"] for r in compute_metrics(df, [
            Metric("missing_rate", id="s", column="s"), Metric("missing_rate", id="all"),
            Metric("null_rate", id="d", column="d"), Metric("duplicate_count", id="dup", columns=["k", "s"]),
            Metric("nunique", id="u", column="d"), Metric("max_share", id="top", column="k"),
            Metric("sum", id="num", column="s")]).collect()}
        assert got["s"] == pytest.approx(blank.mean())
        assert got["all"] == pytest.approx((blank.sum() + pdf["d"].isna().sum()) / (3 * n))
        assert got["d"] == pytest.approx(pdf["d"].isna().mean())
        assert got["dup"] == pdf.duplicated(["k", "s"]).sum()
        assert got["u"] == pdf["d"].nunique()
        assert got["top"] == pytest.approx(pdf["k"].value_counts(normalize=True).max())
        assert got["num"] == pytest.approx(pd.to_numeric(pdf["s"], errors="coerce").sum())


def test_table_metrics_have_no_value_of_their_own(spark, sales):
    with pytest.raises(ValueError):
        compute_metrics(sales, [Metric("row_count", group_by="region")])
    result = run_suite(spark, {"sales": sales}, {"metrics": [
        {"id": "g", "type": "row_count", "group_by": "region"}]})
    assert rows(result.metrics)[0]["value"] == 3
    assert sorted(result.tables) == ["virtual:g"]


def test_any_id_and_many_metrics(spark, sales):
    odd = ["it's", 'say "x"', "back\\slash", "${spark.app.name}", "a.b|c`d", "é\n"]
    got = {r["metric_id"]: r["value"] for r in compute_metrics(sales, [
        Metric("count_where", id=name, filter=f"quantity > {i}") for i, name in enumerate(odd)]).collect()}
    assert got == {name: 4.0 for name in odd}
    many = [Metric("count_where", id=f"m{i}", filter=f"quantity > {i % 30}") for i in range(200)]
    frame = compute_metrics(sales, many)
    assert {r["metric_id"]: r["value"] for r in frame.collect()} == {
        f"m{i}": sum(q > i % 30 for q in (10, 20, 15, 25)) for i in range(200)}
