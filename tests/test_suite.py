import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from dqspark import DatasetRegistry, check, consolidate, metric, run_suite
from dqspark.functions import local_frame
from dqspark.sources import write_results
from dqspark.operators import METRIC_TYPES
from dqspark.operators.scan import collect_values
from dqspark.plans import (
    check_ids, check_refs, investigation_report, metrics_report, run_summary, status_counts,
    summarize, validate_suite, tests_report as report_of_tests,
)

NORTH = {"conditions": [{"column": "region", "type": "S", "value": "North", "result": True}], "default": False}


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(120).selectExpr(
        "id as customer_id", "if(id % 10 = 0, null, concat('c', id, '@x.fr')) as email",
        "if(id % 15 = 0, -1, 20 + id % 50) as age", "case when id % 3 = 0 then 'North' else 'South' end as region")


def statuses(result):
    return {r["test_id"]: r["status"] for r in result.tests.collect()}


def values(result):
    return {r["metric_id"]: r["value"] for r in result.metrics.collect()}


def test_metric_and_range(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a int, b int")
    result = run_suite(spark, {"ds": df}, {
        "metrics": [{"id": "m1", "type": "missing_rate", "database": "ds", "column": "a"}],
        "tests": [{"id": "t1", "type": "range", "metric": "m1", "low": 0, "high": 0.5},
                  {"id": "t2", "type": "range", "metric": "nope", "low": 0, "high": 1}]})
    assert values(result)["m1"] == pytest.approx(1 / 3)
    assert statuses(result) == {"t1": "SUCCESS", "t2": "FAIL"}
    assert "not found" in rows(result.tests, "test_id")[1]["message"]


def test_definition_shape_with_specific_and_bounds_switches(spark, people):
    suite = {
        "id": "q", "metrics": {"email_missing": {"type": "missing_rate", "specific": {
            "dataset": "people", "column": "email"}}},
        "tests": {
            "on": {"type": "interval_check", "specific": {
                "metric_id": "email_missing", "target_mode": "metric_value", "lower_enabled": True,
                "lower_value": 0, "upper_enabled": True, "upper_value": 0.05}},
            "off": {"type": "interval_check", "specific": {
                "metric_id": "email_missing", "lower_enabled": False, "lower_value": 1,
                "upper_enabled": True, "upper_value": 0.5}},
            "not_on": {"type": "interval_check", "specific": {
                "metric_id": "email_missing", "lower_value": 1, "upper_enabled": True, "upper_value": 0.5}}}}
    result = run_suite(spark, {"people": people}, suite)
    assert statuses(result) == {"on": "FAIL", "off": "SUCCESS", "not_on": "SUCCESS"}
    assert rows(result.investigations)[0]["total_problematic_rows"] == 12


def test_count_style_suite(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [
            {"id": "n", "type": "count", "dataset": "people"},
            {"id": "avg", "type": "avg", "dataset": "people", "column": "age"},
            {"id": "low", "type": "min", "dataset": "people", "column": "age"},
            {"id": "bad_age", "type": "count_where", "dataset": "people", "filter": "age < 0 OR age > 120"},
            {"id": "ids", "type": "nunique", "dataset": "people", "column": "customer_id"}],
        "tests": [
            {"id": "enough", "type": "threshold", "metric": "n", "operator": ">=", "value": 50},
            {"id": "ages", "type": "threshold", "metric": "bad_age", "threshold": {"op": "==", "value": "0"}},
            {"id": "unique", "type": "threshold", "metric": "ids", "threshold": 120},
            {"id": "lowest", "type": "range", "metric": "low", "min": "0", "max": "99"}]})
    assert values(result)["bad_age"] == 8
    assert statuses(result) == {"enough": "SUCCESS", "ages": "FAIL", "unique": "SUCCESS", "lowest": "FAIL"}


def test_bad_metrics_do_not_sink_the_batch(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [
            {"id": "ok", "type": "row_count", "dataset": "people"},
            {"id": "zero", "type": "count_where", "dataset": "people", "filter": "1 / (age - age) > 1"},
            {"id": "syntax", "type": "count_where", "dataset": "people", "filter": "age >> > 2"},
            {"id": "column", "type": "count_where", "dataset": "people", "filter": "weight > 2"},
            {"id": "type", "type": "what", "dataset": "people"},
            {"id": "data", "type": "row_count", "dataset": "nobody"}],
        "tests": [{"id": f"t_{m}", "type": "interval_check", "metric_id": m, "lower": 0}
                  for m in ("ok", "zero", "syntax", "column", "type", "data")]})
    got = {r["metric_id"]: r for r in result.metrics.collect()}
    assert got["ok"]["value"] == 120
    assert {m for m, r in got.items() if r["status"] == "ERROR"} == {"zero", "syntax", "column", "type", "data"}
    assert "DIVIDE_BY_ZERO" in got["zero"]["error"]
    assert statuses(result) == {"t_ok": "SUCCESS"} | {
        f"t_{m}": "SKIPPED" for m in ("zero", "syntax", "column", "type", "data")}
    total = rows(run_summary(result))[0]
    assert (total["metrics_computed"], total["tests_passed"], total["tests_skipped"]) == (1, 1, 5)
    assert total["status"] == "FAILED"


def test_failing_column_tests_are_errors(spark, people):
    result = run_suite(spark, {"people": people}, {"tests": [
        {"id": "no_column", "type": "interval_check", "dataset": "people", "lower": 0},
        {"id": "no_bound", "type": "interval_check", "dataset": "people", "columns": ["age"]},
        {"id": "no_data", "type": "interval_check", "dataset": "nobody", "columns": ["age"], "lower": 0},
        {"id": "where", "type": "interval_check", "dataset": "people", "columns": ["age"], "lower": -5, "where": "gone = 1"},
        {"id": "odd", "type": "odd", "dataset": "people"}]})
    assert set(statuses(result).values()) == {"ERROR"}


def test_named_value_filters(spark, people):
    broken = {"conditions": [{"column": "region", "type": "N", "value": 1, "result": True}], "default": False}
    result = run_suite(spark, {"people": people}, {
        "filters": {"north": NORTH, "broken": broken},
        "metrics": [
            {"id": "kept", "type": "row_count", "filter": "north"},
            {"id": "kept_missing", "type": "missing_rate", "column": "email", "filter": "north"},
            {"id": "both", "type": "row_count", "value_filter": NORTH, "where": "age < 0"},
            {"id": "blocked", "type": "row_count", "filter": "broken"}],
        "tests": [{"id": "t", "type": "threshold", "metric": "blocked", "operator": ">", "value": 0}]})
    got = values(result)
    assert (got["kept"], got["both"]) == (40, 8)
    assert got["kept_missing"] == pytest.approx(0.1)
    blocked = [r for r in result.metrics.collect() if r["metric_id"] == "blocked"][0]
    assert (blocked["status"], blocked["value"]) == ("BLOCKED", None)
    assert statuses(result)["t"] == "SKIPPED"
    checks = result.prechecks.filter("metric_id = 'blocked'").collect()
    assert {r["result"] for r in checks} == {"Fail"} and len(checks) == 2


def test_samples(spark, people):
    with_copies = people.withColumn("group", F.expr("if(customer_id < 6, customer_id % 3, customer_id)"))
    result = run_suite(spark, {"people": with_copies}, {
        "keys": {"people": "customer_id"},
        "metrics": [
            {"id": "mail", "type": "missing_rate", "column": ["email", "age"]},
            {"id": "neg", "type": "count_where", "filter": "age < 0"},
            {"id": "dup", "type": "duplicate_count", "columns": ["group"]},
            {"id": "range", "type": "count_out_of_range", "column": "age", "low": 0, "high": 60, "where": "region = 'North'"}],
        "tests": [
            {"id": "t_mail", "type": "interval_check", "metric_id": "mail", "upper": 0},
            {"id": "t_neg", "type": "threshold", "metric": "neg", "value": 0},
            {"id": "t_dup", "type": "threshold", "metric": "dup", "value": 0},
            {"id": "t_range", "type": "threshold", "metric": "range", "value": 0},
            {"id": "t_cols", "type": "interval_check", "columns": ["age"], "lower": 0, "where": "region = 'South'",
             "target_mode": "dataset_columns"},
            {"id": "t_regex", "type": "regex", "dataset": "people", "column": "email", "pattern": "^c1"}]},
        sample_rows=3)
    report = {r["test_id"]: (r["total_problematic_rows"], r["sample_size"]) for r in result.investigations.collect()}
    low = people.filter("age < 0 or age > 60")
    assert report["t_mail"] == (12, 3)
    assert report["t_neg"] == (8, 3)
    assert report["t_dup"] == (6, 3)
    assert report["t_range"][0] == low.filter("region = 'North'").count()
    assert report["t_regex"][0] == people.filter("not email like 'c1%'").count()
    assert "t_cols" not in report  # negative ages are all in the North
    assert [r["customer_id"] for r in result.samples["t_mail"].collect()] == [0, 10, 20]
    assert [r["customer_id"] for r in result.samples["t_dup"].collect()] == [0, 1, 2]
    together = {}
    for ids, frame in result.sampled:
        assert {r["test_id"] for r in frame.collect()} == set(ids)
        for r in frame.collect():
            together.setdefault(r["test_id"], []).append(r["row"]["customer_id"])
    assert {t: sorted(found) for t, found in together.items()} == {
        t: [r["customer_id"] for r in df.collect()] for t, df in result.samples.items()}
    assert "total_problematic_rows" in investigation_report(result).columns


def test_a_suite_scans_each_dataset_once(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    seen = []
    import dqspark.operators.scan as scan
    original = scan._gather

    def counting(united):
        seen.append(united._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return original(united)
    scan._gather = counting
    try:
        run_suite(spark, {"p": df}, {
            "metrics": [{"id": "a", "type": "missing_rate", "column": "email"},
                        {"id": "b", "type": "count_where", "filter": "age < 0"},
                        {"id": "c", "type": "avg", "column": "age", "where": "region = 'North'"}],
            "tests": [{"id": "t", "type": "interval_check", "columns": ["age"], "lower": -9, "target_mode": "dataset_columns"}]},
            investigations=False)
    finally:
        scan._gather = original
    assert seen == [1]


def test_virtual_datasets_and_references(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [{"id": "M-001", "type": "missing_rate", "column": "email"},
                    {"id": "by", "type": "aggregation_by_column", "group_by": "region", "target": "age"},
                    {"id": "gone", "type": "missing_rate", "column": "zzz"}],
        "tests": [
            {"id": "rule", "type": "interval_check", "metric_id": "M-001", "column_rules": [
                {"columns": ["email_missing_rate"], "upper": 0.5}]},
            {"id": "both", "type": "interval_check", "metric_id": "M-001", "upper": 0.01, "column_rules": [
                {"columns": ["email_missing_rate"], "upper": 0.5}]},
            {"id": "groups", "type": "interval_check", "database": "virtual:by", "columns": ["count"], "lower": 50},
            {"id": "after_error", "type": "interval_check", "database": "virtual:gone", "columns": ["x"], "lower": 0},
            {"id": "schema", "type": "output_schema", "metric_id": "by"},
            {"id": "schema2", "type": "output_schema", "metric_id": "M-001"}]})
    assert statuses(result) == {
        "rule": "SUCCESS", "both": "FAIL", "both:columns": "SUCCESS", "groups": "FAIL",
        "after_error": "SKIPPED", "schema": "SUCCESS", "schema2": "SUCCESS"}
    registry = DatasetRegistry(spark, {"people": people})
    alias = registry.add_virtual("by", result.tables["virtual:by"])
    assert registry.check_refs(alias, ["count"]) == []
    assert "column 'zz' is not in" in registry.check_refs(alias, ["zz"])[0]
    assert registry.check_refs("virtual:x") == ["dataset 'virtual:x' is unknown"]


def test_technical_checks_of_conditions(spark, people):
    result = run_suite(spark, {"people": people}, {"tests": [
        {"id": "ok", "type": "interval_check", "dataset": "people", "columns": ["age"], "lower": -1,
         "where": "region = 'North' and age > 3"},
        {"id": "bad", "type": "interval_check", "dataset": "people", "columns": ["age"], "lower": -1,
         "where": "branch = 'x' and age > 3"}]}, technical_checks=True)
    got = {r["test_id"]: r for r in result.tests.collect()}
    assert got["ok_implicit_columns_presence"]["status"] == "SUCCESS"
    assert got["ok_implicit_columns_type"]["status"] == "SUCCESS"
    assert got["bad_implicit_columns_presence"]["message"] == "column 'branch' is missing"
    assert got["bad_implicit_columns_type"]["status"] == "FAIL"
    report = report_of_tests(result, {"timestamp": "2025-02-03 04:05:06"})
    technical = report.filter("category = 'Technical'").collect()
    assert len(technical) == 4 and all(r["control_id"].startswith("TECH_") for r in technical)
    assert {r["quarter"] for r in report.collect()} == {"Q1 2025"}


def test_reports_have_their_columns(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [{"id": "m", "type": "row_count"}],
        "tests": [{"id": "t", "type": "threshold", "metric": "m", "operator": ">", "value": 1,
                   "general": {"stop_on_failure": True}}]})
    assert metrics_report(result).columns == [
        "ID", "Type", "Name", "Description", "Comments", "Export", "Owner", "Dataset", "Column", "Filter",
        "Execution_Status", "Value", "Error", "Timestamp"]
    report = report_of_tests(result, {"quarter": "2025Q4", "project": "P", "user": "u", "run_version": "v1"})
    assert report.columns == [
        "quarter", "project", "run_version", "control_id", "dataset", "category", "blocking",
        "execution_status", "result", "description", "comments", "error", "user", "timestamp"]
    row = rows(report)[0]
    assert (row["quarter"], row["blocking"], row["result"], row["error"]) == ("2025Q4", "Yes", "PASS", "")
    assert {(r["kind"], r["status"], r["n"]) for r in status_counts(result).collect()} == {
        ("metric", "SUCCESS", 1), ("test", "SUCCESS", 1)}
    assert rows(summarize(result.tests))[0]["status"] == "SUCCESS"


def test_default_ids_are_dotted(spark, people):
    result = run_suite(spark, {"people": people}, {
        "context": {"stream": "S", "project": "P"},
        "metrics": [{"type": "missing_rate", "dataset": "people", "column": "email"}]})
    assert list(values(result)) == ["S.P.?.metric.missing_rate.people.col=email"]


def test_consolidation_prefixes_ids(spark, people):
    suite = {"metrics": [{"id": "m", "type": "row_count"}],
             "tests": [{"id": "t", "type": "threshold", "metric": "m", "operator": "<", "value": 1}]}
    one = run_suite(spark, {"people": people}, suite)
    merged = consolidate([("a", one), ("b", one)])
    assert sorted(values(merged)) == ["a_m", "b_m"]
    assert sorted(statuses(merged)) == ["a_t", "b_t"]
    assert {r["metric_id"] for r in merged.tests.collect()} == {"a_m", "b_m"}


@check("suite_test_failing")
def _failing(context, params):
    return context.load("people").selectExpr(
        "'x' as id", "cast(1 / (age - age) as double) as value", "true as passed", "'m' as message")


@check("suite_test_rows")
def _rows(context, params):
    return local_frame(context.spark, [
        ("measure", 4.0, None, "a number"), ("good", 1.0, True, "fine"), ("bad", context.metrics.get("n"), False, "no")],
        "id string, value double, passed boolean, message string")


def test_custom_checks_phases_and_errors(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [{"id": "n", "type": "row_count"}],
        "scripts": [
            {"id": "s1", "check": "suite_test_rows"}, {"id": "s2", "check": "suite_test_failing"},
            {"id": "s3", "check": "not_registered", "execute_on": "pre_dq"},
            {"id": "s4", "check": "suite_test_rows", "enabled": False}]})
    assert statuses(result) == {"good": "SUCCESS", "bad": "FAIL", "s2": "ERROR", "s3": "ERROR", "s4": "SKIPPED"}
    assert values(result) == {"n": 120, "measure": 4.0}
    assert [r["value"] for r in result.tests.collect() if r["test_id"] == "bad"] == [120]
    assert rows(run_summary(result))[0]["scripts_executed"] == 3
    result.release()
    with pytest.raises(ValueError):
        run_suite(spark, {"people": people}, {"scripts": [{"id": "x", "execute_on": "never"}]})


@metric("suite_test_spread", output={"region": "string", "spread": "int"})
def _spread(df, params):
    return df.groupBy("region").agg((F.max(params["column"]) - F.min(params["column"])).cast("bigint").alias("spread"))


@metric("suite_test_param", label="With a parameter", params=("column",))
def _param(df, params):
    return F.max(params["column"])


def test_metric_types_declare_themselves(spark, people):
    for name, kind in METRIC_TYPES.items():
        assert kind.name == name and kind.label and kind.group and callable(kind.build)
    result = run_suite(spark, {"people": people}, {"metrics": [
        {"id": "given", "type": "suite_test_param", "column": "age"}, {"id": "lacking", "type": "suite_test_param"}]})
    got = {r["metric_id"]: r["error"] for r in result.metrics.collect()}
    assert got["given"] is None and "needs the parameters ['column']" in got["lacking"]


@metric("suite_test_ratio")
def _ratio(df, params):
    return {"value": F.sum("age") / F.count("age"), "oldest": F.max("age")}


def test_custom_metrics(spark, people):
    result = run_suite(spark, {"people": people}, {
        "metrics": [{"id": "r", "type": "suite_test_ratio", "where": "age > 0"},
                    {"id": "s", "type": "suite_test_spread", "column": "age"}],
        "tests": [{"id": "schema", "type": "output_schema", "metric_id": "s"},
                  {"id": "spread", "type": "interval_check", "dataset": "virtual:s", "columns": ["spread"], "upper": 5}]})
    assert values(result)["r"] == people.filter("age > 0").agg(F.avg("age")).first()[0]
    assert statuses(result) == {"schema": "SUCCESS", "spread": "FAIL"}


def test_foreign_keys(spark, people):
    regions = spark.createDataFrame([("North",)], "name string")
    result = run_suite(spark, {"people": people, "regions": regions}, {"tests": [
        {"id": "fk", "type": "foreign_key", "dataset": "people", "column": "region", "ref": "regions.name"},
        {"id": "fk_north", "type": "foreign_key", "dataset": "people", "column": "region", "ref": "regions",
         "ref_column": "name", "where": "region = 'North'"},
        {"id": "fk_unknown", "type": "foreign_key", "dataset": "people", "column": "region", "ref": "zz.name"}]})
    assert statuses(result) == {"fk": "FAIL", "fk_north": "SUCCESS", "fk_unknown": "ERROR"}
    assert [r["value"] for r in result.tests.collect() if r["test_id"] == "fk"] == [80]


def test_check_ids_and_refs(spark):
    suites = spark.createDataFrame(
        [("s", "metric", "a"), ("s", "metric", "a"), ("s", "test", "a"), ("s", "test", "b"), ("t", "test", "a"),
         ("t", "test", "c"), ("t", "test", "c")], "suite_id string, kind string, id string")
    assert {(r["suite_id"], r["id"], r["problem"], r["n"]) for r in check_ids(suites).collect()} == {
        ("s", "a", "duplicate metric", 2), ("s", "a", "metric and test", 3), ("t", "c", "duplicate test", 2)}
    tests = spark.createDataFrame(
        [("s", "1", "m", None, None), ("s", "2", "x", None, None), ("t", "3", "m", None, None),
         ("s", "4", None, "d", "c"), ("s", "5", None, "d", "z"), ("s", "6", None, "e", "c"), ("s", "7", None, "d", None)],
        "suite_id string, test_id string, metric_id string, dataset string, column string")
    metrics = spark.createDataFrame([("s", "m")], "suite_id string, metric_id string")
    datasets = spark.createDataFrame([("d", "c")], "dataset string, column string")
    assert {(r["test_id"], r["problem"], r["reference"]) for r in check_refs(tests, metrics, datasets).collect()} == {
        ("2", "unknown metric", "x"), ("3", "unknown metric", "m"), ("5", "unknown column", "d.z"),
        ("6", "unknown dataset", "e")}


def test_suite_validation(spark, people):
    suite = {"metrics": [{"id": "m", "type": "row_count"}, {"id": "x", "type": "row_count"}],
             "tests": [{"id": "x", "type": "threshold", "metric": "m", "value": 1},
                       {"id": "u", "type": "threshold", "metric": "gone", "value": 1},
                       {"id": "c", "type": "interval_check", "dataset": "people", "columns": ["age", "zz"], "lower": 1},
                       {"id": "d", "type": "interval_check", "database": "nobody", "column": "age", "lower": 1}]}
    assert {tuple(r) for r in validate_suite(spark, suite, {"people": people}).collect()} == {
        ("x", "metric and test", None), ("u", "unknown metric", "gone"), ("c", "unknown column", "people.zz"),
        ("d", "unknown dataset", "nobody")}
    with pytest.raises(ValueError, match="more than once"):
        run_suite(spark, {"people": people}, suite)


def test_globals_set_sample_size_and_severity(spark, people):
    result = run_suite(spark, {"people": people}, {
        "globals": {"sample_size": 4, "default_severity": "low"}, "keys": {"people": "customer_id"},
        "metrics": [{"id": "m", "type": "missing_rate", "column": "email"}],
        "tests": [{"id": "t", "type": "interval_check", "metric_id": "m", "upper": 0}]})
    assert rows(result.investigations)[0]["sample_size"] == 4 == result.samples["t"].count()
    assert rows(result.tests)[0]["severity"] == "low"


def test_nothing_to_compute(spark, people):
    assert collect_values([]) == ({}, {})
    result = run_suite(spark, {"people": people}, {})
    assert result.metrics.count() == result.tests.count() == 0
    assert rows(run_summary(result))[0]["status"] == "SUCCESS"


def test_written_samples_are_whole_and_a_rerun_leaves_none_behind(spark, tmp_path):
    suite = {"id": "s", "keys": {"d": "id"}, "metrics": [{"id": "m", "type": "missing_rate", "dataset": "d", "column": "v"}],
             "tests": [{"id": "script_like", "type": "interval_check", "metric_id": "m", "upper": 0}]}
    df = spark.range(4000).selectExpr("id", "cast(null as string) as v", "map('a', id) as m")
    for run in ("r1", "r2"):
        result = run_suite(spark, {"d": df}, suite, run_id=run, sample_rows=3000)
        paths = write_results(result, str(tmp_path))
    written = spark.read.parquet(paths["samples"]).filter("run_id = 'r1'")
    ids = [json.loads(r["row"])["id"] for r in written.collect()]
    assert sorted(ids) == list(range(3000))
    assert sorted(r["id"] for r in result.samples["script_like"].collect()) == list(range(3000))
    unkeyed = run_suite(spark, {"d": df}, {**suite, "keys": {}}, sample_rows=50)
    (_, frame), = unkeyed.sampled
    assert {r["id"] for r in unkeyed.samples["script_like"].collect()} == {r["row"]["id"] for r in frame.collect()}
    clean = run_suite(spark, {"d": df.withColumn("v", F.lit("x"))}, suite, run_id="r1")
    paths = write_results(clean, str(tmp_path))
    for name in ("samples", "investigations"):
        assert [r["run_id"] for r in spark.read.parquet(paths[name]).select("run_id").distinct().collect()] == ["r2"]


def test_no_bound_is_nan(spark):
    df = spark.range(5)
    tests = [{"id": "a", "type": "interval_check", "metric_id": "n", "upper": "nan"},
             {"id": "b", "type": "interval_check", "dataset": "d", "columns": ["id"], "upper": float("nan")},
             {"id": "c", "type": "threshold", "metric": "n", "operator": "!=", "value": "nan"}]
    result = run_suite(spark, {"d": df}, {"id": "s", "metrics": [{"id": "n", "type": "row_count", "dataset": "d"}], "tests": tests})
    assert {r["status"] for r in result.tests.collect()} <= {"FAIL", "ERROR"}


def test_every_kind_of_failed_test_shows_its_rows(spark):
    df = spark.sql("""select id, if(id % 4 = 0, null, id) as v, concat('m', id, if(id % 3 = 0, '', '@x.org')) as mail,
        if(id % 5 = 0, 'never', '2024-01-02') as day, id % 7 as k from range(60)""")
    ref = spark.range(5).toDF("k")
    metrics = [
        {"id": "nulls", "type": "null_rate", "column": "v"}, {"id": "rule", "type": "rule_share", "filter": "v < 30"},
        {"id": "mails", "type": "regex_share", "column": "mail"}, {"id": "days", "type": "date_share", "column": "day"},
        {"id": "full", "type": "avg_completion_rate"}, {"id": "lost", "type": "orphan_count", "column": "k", "ref": "ref"}]
    low = {"nulls", "lost"}
    suite = {"id": "s", "keys": {"d": "id"}, "metrics": [{**m, "dataset": "d"} for m in metrics], "tests": [
        {"id": f"t_{m['id']}", "type": "interval_check", "metric_id": m["id"], **({"upper": 0} if m["id"] in low else {"lower": 1})}
        for m in metrics] + [{"id": "fk", "type": "foreign_key", "dataset": "d", "column": "k", "ref": "ref.k"}]}
    result = run_suite(spark, {"d": df, "ref": ref}, suite, sample_rows=1000)
    ids = {t: [r["id"] for r in s.collect()] for t, s in result.samples.items()}
    want = {"t_nulls": lambda i: i % 4 == 0, "t_rule": lambda i: i % 4 == 0 or i >= 30, "t_mails": lambda i: i % 3 == 0,
            "t_days": lambda i: i % 5 == 0, "t_full": lambda i: i % 4 == 0, "t_lost": lambda i: i % 7 >= 5, "fk": lambda i: i % 7 >= 5}
    assert {t: sorted(x) for t, x in ids.items()} == {t: [i for i in range(60) if f(i)] for t, f in want.items()}
    totals = {r["test_id"]: r["total_problematic_rows"] for r in result.investigations.collect()}
    assert totals == {t: len(x) for t, x in ids.items()}
    quiet = {**suite, "tests": [{**t, "general": {"sample_on_fail": False}} for t in suite["tests"]]}
    assert run_suite(spark, {"d": df, "ref": ref}, quiet).investigations.count() == 0


def test_named_filters_hold_for_tests(spark):
    df = spark.range(10).selectExpr("id", "if(id < 5, 'n', 's') as area", "id * 10 as v")
    north = {"conditions": [{"column": "area", "type": "S", "value": "n", "result": True}], "default": False}
    suite = {"id": "s", "keys": {"d": "id"}, "filters": {"north": north}, "tests": [
        {"id": "a", "type": "interval_check", "dataset": "d", "columns": ["v"], "upper": 40, "filter": "north"},
        {"id": "b", "type": "interval_check", "dataset": "d", "columns": ["v"], "upper": 30, "filter": north}]}
    result = run_suite(spark, {"d": df}, suite)
    assert {r["test_id"]: r["status"] for r in result.tests.collect()} == {"a": "SUCCESS", "b": "FAIL"}
    assert [r["id"] for r in result.samples["b"].collect()] == [4]


def test_scripts_share_no_id_with_tests(spark):
    with pytest.raises(ValueError, match="more than once"):
        run_suite(spark, {"d": spark.range(1)}, {"tests": [{"id": "x", "type": "interval_check", "columns": ["id"], "upper": 1}],
                                                 "scripts": [{"id": "x", "check": "c"}]})


def jobs_of(spark, monkeypatch, probes, fail=None):
    from dqspark.operators import scan
    count = [0]
    real = scan._gather

    def counted(df):
        count[0] += 1
        if fail:
            raise fail
        return real(df)
    monkeypatch.setattr(scan, "_gather", counted)
    try:
        return count, collect_values(probes)
    except Exception as error:
        return count, error


def test_only_values_are_asked_for_again(spark, monkeypatch):
    from dqspark.operators.scan import Probe, Scan
    df = spark.range(10)
    def ask(i):
        return F.sum(F.expr("1 div (id - id)")) if i == 41 else F.sum(F.col("id") + i)
    probes = [Probe(f"p{i}", "d", df, Scan(lambda scope, i=i: {"value": ask(i)})) for i in range(65)]
    count, (answers, errors) = jobs_of(spark, monkeypatch, probes)
    assert list(errors) == ["p41"] and len(answers) == 64 and count[0] <= 9
    count, error = jobs_of(spark, monkeypatch, probes, RuntimeError("the cluster is gone"))
    assert isinstance(error, RuntimeError) and count[0] == 1


def test_a_report_reads_the_same_each_time(spark):
    result = run_suite(spark, {"d": spark.range(3)}, {"metrics": [{"id": "m", "type": "row_count"}],
                       "tests": [{"id": "t", "type": "interval_check", "metric_id": "m", "upper": 9}]})
    assert report_of_tests(result).collect() == report_of_tests(result).collect()


def test_custom_metrics_share_one_scan(spark, tmp_path):
    from dqspark.operators.metrics import build_probe, Metric
    from dqspark.operators.scan import long_values
    for i in range(3):
        metric(f"plus_{i}")(lambda df, params, i=i: F.sum(F.col("id") + i))
    try:
        spark.range(10).write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
        probes = [build_probe(Metric(f"plus_{i}", id=f"m{i}"), df, None, "d") for i in range(3)]
        plan = long_values(probes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        suite = {"metrics": [{"id": f"m{i}", "type": f"plus_{i}"} for i in range(3)] + [{"id": "w", "type": "plus_0", "where": "id < 3"}]}
        got = {r["metric_id"]: r["value"] for r in run_suite(spark, {"d": df}, suite).metrics.collect()}
        assert got == {"m0": 45.0, "m1": 55.0, "m2": 65.0, "w": 3.0}
    finally:
        for i in range(3):
            METRIC_TYPES.pop(f"plus_{i}")
