import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from conftest import rows

from dqspark import DatasetRegistry, load, run_suite
from dqspark.functions import (
    apply_value_filter, check_value_filter, predicate_columns, resolve_columns, value_filter_prechecks,
)
from dqspark.plans import investigation_report
from dqspark.sources import preview, sample, schema_table, work_folder, write_results, write_sample

UPLOAD = """﻿meter,read_on,level,site,note
m7,2021-03-04,12.25,north,ok
m8,2021-03-05,NA,south,null
m9,soon,-3,,late
m9,2021-03-07,NaN,south,twice
m10,2021-03-08,4000,west,ok
"""


@pytest.fixture
def upload(tmp_path):
    path = tmp_path / "upload.csv"
    path.write_text(UPLOAD, encoding="utf-8")
    return str(path)


def test_csv_with_byte_order_mark_and_missing_tokens(spark, upload):
    plain = load(spark, upload)
    assert plain.columns[0] == "meter"
    assert dict(plain.dtypes)["level"] == "string"
    typed = load(spark, upload, null_tokens=["NA", "NaN", "null"])
    assert dict(typed.dtypes)["level"] == "double"
    assert [r["level"] for r in typed.collect()] == [12.25, None, -3.0, None, 4000.0]
    given = load(spark, upload, schema="meter string, read_on date, level double, site string, note string",
                 null_tokens=["NA", "null"])
    assert given.filter("read_on is null").count() == 1


def test_other_text_formats(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert [tuple(r) for r in load(spark, str(tmp_path / "t.tsv")).collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "s.csv").write_text("a;b\n1;é\n".encode("latin-1").decode("latin-1"), encoding="latin-1")
    found = load(spark, str(tmp_path / "s.csv"), options={"sep": ";", "encoding": "ISO-8859-1"}).first()
    assert tuple(found) == (1, "é")
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "r.json").write_text(json.dumps(records, indent=1))
    assert load(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    assert load(spark, str(tmp_path / "r.jsonl")).count() == 2


def test_text_under_a_parquet_name(spark, tmp_path):
    path = tmp_path / "customers.parquet"
    path.write_text("customer_id,name\n1,Ana\n2,Bo\n")
    assert load(spark, str(path)).columns == ["customer_id", "name"]
    with pytest.raises(Exception):
        load(spark, str(path), fallback_csv=False)
    with pytest.raises(Exception):
        load(spark, str(tmp_path / "absent.parquet"))
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"PAR1 and then nothing of use")
    with pytest.raises(Exception):
        load(spark, str(broken))


def test_frames_tables_and_queries(spark, tmp_path):
    assert load(spark, frame=pd.DataFrame({"a": [1, 2]})).count() == 2
    load(spark, frame=pd.DataFrame({"a": [1, 2]})).createOrReplaceTempView("dq_numbers")
    assert load(spark, "dq_numbers").count() == load(spark, table="dq_numbers").count() == 2
    assert load(spark, query="select max(a) as top from dq_numbers").first()["top"] == 2
    with pytest.raises(ValueError):
        load(spark)
    with pytest.raises(ValueError):
        load(spark, "x", "xlsx")


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert [r["k"] for r in sample(df.repartition(7), "head", 5, key="k").collect()] == [0, 1, 2, 3, 4]
    one = {r["k"] for r in sample(df.repartition(7), "random", 50, key="k", seed=3).collect()}
    two = {r["k"] for r in sample(df.coalesce(1), "random", 50, key="k", seed=3).collect()}
    other = {r["k"] for r in sample(df, "random", 50, key="k", seed=4).collect()}
    assert one == two and one != other and len(one) == 50
    assert sample(df, "full").count() == 1000
    assert preview(df).count() == 10
    with pytest.raises(ValueError):
        sample(df, "head")
    with pytest.raises(ValueError):
        sample(df, "best", key="k")
    assert rows(schema_table(df)) == [{"position": 0, "column": "k", "type": "bigint"}]


def test_a_large_draw_takes_the_same_rows(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = {n: {r["k"] for r in sample(df, "random", n, key="k", seed=2).collect()} for n in (1, 777, 4999, 5000)}
    for n, ids in want.items():
        got = [r["k"] for r in sample(df.repartition(6), "random", n, key="k", seed=2).collect()]
        assert len(got) == n and set(got) == ids
    assert sample(df, "random", 9000, key="k").count() == 5000


def test_registry(spark, upload):
    registry = DatasetRegistry(
        spark, [{"alias": "sales", "name": "Sales file", "source": {"kind": "local", "path": upload}},
                {"alias": "small", "source": pd.DataFrame({"a": [1]})}],
        overrides={"extra": pd.DataFrame({"a": [1, 2, 3]})})
    assert registry["sales"].count() == registry["Sales file"].count() == registry["upload.csv"].count() == 5
    assert registry["extra"].count() == 3 and sorted(registry) == ["extra", "sales", "small"]
    with pytest.raises(KeyError):
        registry["nobody"]
    with pytest.raises(ValueError):
        DatasetRegistry(spark, [{"source": {"path": "x"}}])
    with pytest.raises(ValueError):
        DatasetRegistry(spark, [{"alias": "s", "source": {"kind": "sharepoint", "path": "x"}}])
    assert registry.cached("small").is_cached
    registry.release()
    assert not registry["small"].is_cached
    replaced = DatasetRegistry(spark, {"sales": upload}, overrides={"sales": pd.DataFrame({"a": [7]})})
    assert replaced["sales"].first()["a"] == 7
    registry.create_views()
    assert spark.table("sales").count() == 5


def test_sinks(spark, tmp_path):
    people = spark.range(30).selectExpr("id", "if(id % 5 = 0, null, 'n') as name")
    suite = {"keys": {"people": "id"},
             "metrics": [{"id": "m", "type": "missing_rate", "column": "name"}],
             "tests": [{"id": "t", "type": "interval_check", "metric_id": "m", "upper": 0},
                       {"id": "my_script_test", "type": "interval_check", "metric_id": "m", "upper": 0}]}
    result = run_suite(spark, {"people": people}, suite, run_id="r1")
    paths = write_results(result, str(tmp_path / "out"))
    paths = write_results(result, str(tmp_path / "out"))  # a rerun changes nothing
    write_results(run_suite(spark, {"people": people}, suite, run_id="r2"), str(tmp_path / "out"))
    metrics = spark.read.parquet(paths["metrics"])
    assert {(r["run_id"], r["metric_id"]) for r in metrics.collect()} == {("r1", "m"), ("r2", "m")}
    samples = spark.read.parquet(paths["samples"]).filter("run_id = 'r1'").collect()
    assert {r["test_id"] for r in samples} == {"t", "my_script_test"}
    assert sum(r["test_id"] == "t" for r in samples) == 6
    report = investigation_report(result, str(tmp_path / "samples"), "20250101").collect()
    assert {r["sample_file"].rsplit("/", 1)[1] for r in report} == {
        "t_sample_20250101.csv", "my_script_test_sample_20250101.csv"}
    assert spark.read.csv(report[0]["sample_file"], header=True).count() == 6
    path = write_sample(people.limit(2), str(tmp_path), "t", "x", "1")
    assert spark.read.csv(path, header=True).columns == ["id", "name"]


def test_work_folder_is_the_shared_one(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = work_folder(spark, "trial")
    assert before is None or path.startswith(before)
    assert work_folder(spark, "trial") != path


def test_columns_of_predicates(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert predicate_columns(spark, "a > 1 and (upper(b) like 'X%' or c in (1, 2))", df) == ["a", "b", "c"]
    assert predicate_columns(spark, "gone = 1 and a > 0", df) == ["gone", "a"]
    assert predicate_columns(spark, "1 = 1") == []
    assert resolve_columns(df, ["c", "zz", "a", "c"]) == ["c", "a"]
    assert resolve_columns(df, None) == resolve_columns(df, []) == ["a", "b", "c"]


def test_value_filters(spark):
    df = spark.createDataFrame([("North", 10), ("South", 10), (None, 10), ("North", 3)], "region string, quantity int")
    first_wins = {"conditions": [
        {"column": "region", "type": "S", "value": "North", "result": True},
        {"column": "quantity", "type": "N", "value": 10, "result": False}], "default": True}
    assert apply_value_filter(df, first_wins).count() == 2
    repeated = {"conditions": [
        {"column": "region", "type": "S", "value": "North", "result": True},
        {"column": "region", "type": "S", "value": "North", "result": False}], "default": True}
    assert apply_value_filter(df, repeated).count() == 2
    assert apply_value_filter(df, {"conditions": [], "default": False}).count() == 0
    other_kind = {"conditions": [{"column": "quantity", "type": "N", "value": "ten", "result": True}], "default": False}
    assert apply_value_filter(df, other_kind).count() == 0
    days = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as day")
    assert apply_value_filter(days, {"conditions": [
        {"column": "day", "type": "T", "value": "2024-01-01", "result": True}], "default": False}).count() == 1


def test_value_filter_problems(spark):
    schema = spark.createDataFrame([], "region string, quantity int, price decimal(9,2), d date").schema
    good = [{"column": c, "type": t, "value": 1, "result": True}
            for c, t in (("region", "S"), ("quantity", "I"), ("quantity", "N"), ("price", "F"), ("price", "N"), ("d", "T"), ("d", "D"))]
    assert check_value_filter(schema, {"conditions": good, "default": False}) == []
    bad = {"conditions": [
        {"column": "region", "type": "N", "value": 1, "result": True},
        {"column": "gone", "type": "S", "value": 1, "result": True},
        {"column": "quantity", "type": "Q", "value": 1, "result": "yes"}]}
    assert len(check_value_filter(schema, bad)) == 5
    assert len(check_value_filter(schema, {"conditions": [], "default": [True, False]})) == 1
    frame, reason = value_filter_prechecks(spark, "f", schema, {"conditions": good[:1], "default": True}, "sales", "raw")
    assert reason is None
    assert [(r["control_id"], r["result"]) for r in frame.collect()] == [("SAL_RAW_T-001", "Pass"), ("SAL_RAW_T-002", "Pass")]


def test_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("amount,id,more\n8,2,x\n9,3,y\n")
    df = load(spark, str(tmp_path / "a.csv"), schema="id int, amount double")
    assert rows(df, "id") == [{"id": 2, "amount": 8.0}, {"id": 3, "amount": 9.0}]
    with pytest.raises(ValueError, match="branch"):
        load(spark, str(tmp_path / "a.csv"), schema="id int, branch string")
    with pytest.raises(ValueError, match="branch"):
        load(spark, str(tmp_path / "a.csv"), schema="id int, branch string", null_tokens=["NA"])


def test_null_tokens_do_not_change_the_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,true,1.5,2024-01-02\n2,false,2,2024-02-03\n")
    plain, tokens = (load(spark, str(tmp_path / "t.csv"), null_tokens=t) for t in ((), ("NA",)))
    assert plain.dtypes == tokens.dtypes


@pytest.mark.parametrize("n", (100, 10_000, 1_000_000))
def test_first_rows_are_cut_in_every_task_and_the_scan_keeps_its_tasks(spark, n):
    df = spark.range(0, 1000, numPartitions=8).select(F.explode(F.array("id")).alias("k"))  # of unknown length
    for frame in (sample(df, "head", n, key="k"), sample(df, "random", n, key="k"), preview(df, n, "k")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce" not in plan and ("TakeOrderedAndProject" in plan or "LocalLimit" in plan)
