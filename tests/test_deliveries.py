import pytest
from conftest import rows
from pyspark.sql import functions as F

from dqspark.operators import (
    duplicate_total, investigate_bounds, investigate_duplicates, investigate_missing, investigate_where,
)
from dqspark.operators import skew
from dqspark.plans import (
    channel_stats, definition_stats, definition_values, filename_check, flatten_inventory,
    missing_files, process_delivery, recent, verdict, zone_counts,
)
from dqspark.streaming import watch_deliveries


def test_missing_files(spark):
    spec = spark.createDataFrame(
        [("c", "f1", "Sales", True), ("c", "f2", "Stores", True), ("c", "f3", "Notes", False), ("d", "g", "G", True)],
        "channel_id string, file_id string, name string, required boolean")
    submissions = spark.createDataFrame([("s1", "c"), ("s2", "c"), ("s3", "d")], "submission_id string, channel_id string")
    delivered = spark.createDataFrame(
        [("s1", "f1"), ("s1", "f1"), ("s3", "g")], "submission_id string, file_id string")
    got = {(r["submission_id"], r["file_id"]) for r in missing_files(spec, submissions, delivered).collect()}
    assert got == {("s1", "f2"), ("s2", "f1"), ("s2", "f2")}


def test_filenames(spark):
    spec = spark.createDataFrame(
        [("c", "f1", r"^sales_\d{4}\.csv$"), ("c", "f2", None)], "channel_id string, file_id string, pattern string")
    delivered = spark.createDataFrame(
        [("s1", "c", "f1", "sales_2024.csv"), ("s2", "c", "f1", "sales.csv"), ("s3", "c", "f2", "any"), ("s4", "c", "f9", "x")],
        "submission_id string, channel_id string, file_id string, file_name string")
    got = {r["submission_id"]: (r["passed"], r["message"]) for r in filename_check(delivered, spec).collect()}
    assert got == {"s1": (True, "OK"), "s2": (False, "name does not match"), "s3": (True, "OK"),
                   "s4": (False, "no specification")}


def test_verdicts(spark):
    tests = spark.createDataFrame(
        [("a", "SUCCESS"), ("b", "SUCCESS"), ("b", "FAIL"), ("c", "SKIPPED"), ("c", "SUCCESS"), ("d", "ERROR"), ("d", "FAIL")],
        "submission_id string, status string")
    assert {r["submission_id"]: (r["verdict"], r["accepted"]) for r in verdict(tests).collect()} == {
        "a": ("DQ_SUCCESS", True), "b": ("REJECTED", False), "c": ("DQ_FAILED", False), "d": ("ERROR", False)}
    by_hand = spark.createDataFrame([("b",), ("b",)], "submission_id string")
    assert {r["submission_id"] for r in verdict(tests, by_hand).filter("accepted").collect()} == {"a", "b"}


def test_channel_statistics_and_recent(spark):
    submissions = spark.range(300).selectExpr(
        "cast(id as string) as submission_id", "if(id % 3 = 0, 'x', 'y') as channel_id",
        "if(id % 2 = 0, 'dq_success', 'rejected') as status", "timestamp_seconds(id div 2) as submitted_at")
    stats = {r["channel_id"]: r for r in channel_stats(submissions).collect()}
    assert (stats["y"]["total_submissions"], stats["y"]["rejected"], stats["y"]["success_rate"]) == (200, 100, 50.0)
    assert recent(submissions).count() == 100
    assert [r["submission_id"] for r in recent(submissions, "x", 3).collect()] == ["297", "294", "291"]


def test_inventory(spark):
    inventory = spark.sql("""
        select 'A' as id, array(named_struct('id', 'P1', 'zones', array(
            named_struct('id', 'raw', 'datasets', array(
                named_struct('name', 'sales.csv', 'alias', 'sales', 'path', '/s'),
                named_struct('name', cast(null as string), 'alias', 'x', 'path', '/x'))),
            named_struct('id', 'trusted', 'datasets', cast(array() as array<struct<name: string, alias: string, path: string>>))
        ))) as projects""")
    flat = flatten_inventory(inventory)
    assert {(r["zone"], r["dataset"], r["alias"]) for r in flat.collect()} == {
        ("raw", "sales.csv", "sales"), ("raw", "", "x"), ("trusted", "-", "-")}
    assert {r["zone"]: r["datasets_count"] for r in zone_counts(flat).collect()} == {"raw": 2, "trusted": 0}


def test_definitions(spark):
    defs = spark.createDataFrame(
        [("dq_sales", "Sales", "A", "P1", "raw", "2025Q4", ["s", "t"], 3, 2), ("dq_hr", "People", "B", "N/A", "raw", "2025Q3", ["t"], 1, 1)],
        "id string, label string, stream string, project string, zone string, quarter string, datasets array<string>, "
        "metrics_count int, tests_count int")
    assert rows(definition_stats(defs))[0] == {
        "total_definitions": 2, "total_metrics": 4, "total_tests": 3, "total_datasets": 2}
    assert rows(definition_stats(defs, "2025Q4", "SALE"))[0]["total_metrics"] == 3
    assert rows(definition_stats(defs, "all", "nothing"))[0] == {
        "total_definitions": 0, "total_metrics": 0, "total_tests": 0, "total_datasets": 0}
    projects = definition_values(defs).filter("field = 'project'").collect()
    assert [(r["value"], r["definitions"]) for r in projects] == [("P1", 1)]


def test_investigations(spark):
    df = spark.createDataFrame(
        [(3, "a", 5.0), (1, None, 50.0), (2, " ", -1.0), (5, "b", None), (4, "a", 7.0), (6, None, 7.0)],
        "id int, name string, v double")
    assert [r["id"] for r in investigate_missing(df, ["name"], "id").collect()] == [1, 2, 6]
    assert [r["id"] for r in investigate_missing(df, None, "id", 2).collect()] == [1, 2]
    assert [r["id"] for r in investigate_where(df, "v > 6", "id").collect()] == [1, 4, 6]
    assert [r["id"] for r in investigate_bounds(df, {"v": (0, 10), "gone": (0, 1)}, "id").collect()] == [1, 2]
    assert [r["id"] for r in investigate_duplicates(df, "name", "id").collect()] == [1, 3, 4, 6]
    assert [r["id"] for r in investigate_duplicates(df, ["name"], ["v", "id"], 2).collect()] == [3, 4]
    assert duplicate_total(df, "name").first()["value"] == 4


def test_duplicate_samples_against_brute_force(spark):
    df = spark.range(2000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 1400) end as k",
        "(id * 7919) % 2000 as place")
    pdf = df.toPandas()
    sizes = pdf.groupby("k", dropna=False)["id"].transform("size")
    for n in (1, 7, 100, 5000):
        want = pdf[sizes > 1].sort_values("place")["id"].head(n).tolist()
        for digest in (False, True):
            got = [r["id"] for r in investigate_duplicates(df.repartition(5), "k", "place", n, digest).collect()]
            assert got == want


def test_salted_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "PARTS", 7)
    left = spark.range(900).selectExpr("id", "case when id % 3 = 0 then 1 when id % 3 = 1 then 2 else id % 97 end as k")
    left = left.unionByName(spark.createDataFrame([(-1, None)], "id bigint, k bigint"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c"), (None, "d")], "k bigint, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        got = skew.salted_join(left, right, ["k"], how, ["id"])
        assert sorted(map(str, got.collect())) == want
        assert got.columns == left.join(right, "k", how).columns


def test_stream_intake(spark, tmp_path):
    landing, sink = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    suite = {"metrics": [{"id": "n", "type": "row_count"}],
             "tests": [{"id": "positive", "type": "interval_check", "columns": ["amount"], "lower": 0,
                        "target_mode": "dataset_columns"}]}

    def run():
        query = watch_deliveries(
            spark, str(landing), suite, str(sink), schema="id int, amount double", alias="sales",
            checkpoint=str(tmp_path / "check"), files_per_batch=1, available_now=True)
        query.awaitTermination()

    (landing / "a.csv").write_text("id,amount\n1,5\n2,6\n")
    run()
    (landing / "b.csv").write_text("id,amount\n3,-5\n")
    run()
    run()  # nothing new, nothing twice
    metrics = spark.read.parquet(str(sink / "metrics"))
    assert sorted(r["value"] for r in metrics.collect()) == [1.0, 2.0]
    verdicts = spark.read.parquet(str(sink / "verdicts"))
    assert {r["submission_id"]: r["verdict"] for r in verdicts.collect()} == {
        "batch_0": "DQ_SUCCESS", "batch_1": "REJECTED"}


def test_process_delivery(spark, tmp_path):
    (tmp_path / "sales_1.csv").write_text("id,amount,shop\n1,5,a\n2,,b\n3,7,zz\n")
    (tmp_path / "shops.csv").write_text("shop\na\nb\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    suite = {"id": "q", "keys": {"sales": "id"},
             "metrics": [{"id": "m", "type": "missing_rate", "dataset": "sales", "column": "amount"}],
             "tests": [{"id": "t", "type": "interval_check", "metric_id": "m", "upper": 0.5}]}
    keys = {"id": "k", "tests": [
        {"id": "fk", "type": "foreign_key", "dataset": "sales", "column": "shop", "ref": "shops.shop"}]}
    broken = {"id": "b", "metrics": [{"id": "m", "type": "row_count", "dataset": "sales"}],
              "tests": [{"id": "odd", "type": "odd", "metric_id": "m"}]}

    def deliver(files, *suites, **options):
        channel = {"channel_id": "c", "suites": list(suites), "files": [
            {"file_id": "f1", "name": "Sales", "alias": "sales", "pattern": "^sales_", "schema_validation": True,
             "expected_columns": ["id", "amount"]},
            {"file_id": "f2", "name": "Shops", "alias": "shops", "required": False}]}
        return process_delivery(
            spark, channel, "s", {f: str(tmp_path / path) for f, path in files.items()}, **options)

    both = {"f1": "sales_1.csv", "f2": "shops.csv"}
    good = deliver(both, suite)
    assert (good.status, good.accepted, good.errors) == ("DQ_SUCCESS", True, [])
    bad = deliver(both, suite, keys)
    assert (bad.status, bad.accepted) == ("REJECTED", False)
    assert sorted(r["test_id"] for r in bad.result.tests.collect()) == ["k_fk", "q_t"]
    assert deliver(both, suite, keys, accept_by_hand=True).accepted
    assert deliver(both, suite, broken).status == "ERROR"
    assert deliver(both).status == "DQ_SUCCESS"
    lacking = deliver({"f2": "shops.csv"}, suite)
    assert (lacking.status, lacking.errors) == ("ERROR", ["required file missing: Sales (f1)"])
    misnamed = deliver({"f1": "other.csv"}, suite)
    assert misnamed.errors == ["other.csv (f1): name does not match"]
    (tmp_path / "sales_x.csv").write_text("x\n1\n")
    assert deliver({"f1": "sales_x.csv"}, suite).errors == ["Sales: columns are missing: id, amount"]
    assert deliver({"f1": "sales_none.csv"}, suite).status == "ERROR"
    many = {"id": "m", "metrics": broken["metrics"],
            "tests": [{"id": f"odd{i}", "type": "odd", "metric_id": "m"} for i in range(130)]}
    errored = deliver(both, many)
    assert (errored.status, errored.errored, errored.broken.count(), errored.errors) == ("ERROR", 130, 130, [])


def test_declared_columns_are_looked_for_in_the_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("customer,amount\n1,2\n")
    channel = {"channel_id": "c", "files": [
        {"file_id": "f", "name": "F", "format": "csv", "schema": "id int, amount int, branch string",
         "schema_validation": True, "expected_columns": ["id", "amount", "branch"]}]}
    done = process_delivery(spark, channel, "s", {"f": str(tmp_path / "f.csv")})
    assert (done.status, done.errors) == ("ERROR", ["F: columns are missing: id, branch"])


def test_a_stream_started_again_goes_on(spark, tmp_path):
    landing, sink = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    suite = {"metrics": [{"id": "n", "type": "sum", "column": "id"}]}
    for i in range(2):
        (landing / f"f{i}.csv").write_text("id,amount\n" + "1,2\n" * (i + 2))
        watch_deliveries(spark, str(landing), suite, sink, schema="id int, amount int", alias="d",
                         available_now=True).awaitTermination()
    got = spark.read.parquet(f"{sink}/metrics").select("batch_id", "value").collect()
    assert sorted(map(tuple, got)) == [(0, 2.0), (1, 3.0)]
    (landing / "g.csv").write_text("amount,id\n1,2\n")
    query = watch_deliveries(spark, str(landing), suite, sink, schema="id int, amount int", alias="d", available_now=True)
    with pytest.raises(Exception, match="header"):
        query.awaitTermination()
