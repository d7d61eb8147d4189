"""Arrays of records against Python's own parser, cut into splits of a few bytes."""

import json
import random

import pytest

from dqspark.sources import load

SCHEMA = "id int, text string, inner struct<a: int, deep: struct<s: string>>, list array<struct<x: int>>"
WORDS = ["plain", "}", "{", '"', "\\", '\\"', "[{", "},{", "\\}", "é}", "\n", "]"]


def records(n, seed):
    r = random.Random(seed)
    return [{"id": i, "text": "".join(r.choices(WORDS, k=r.randint(0, 6))), "inner": r.choice([None, {"a": 1, "deep": {"s": r.choice(WORDS)}}]),
             "list": [{"x": j} for j in range(r.randint(0, 3))]} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("64", "0", "40")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def told(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def test_records_across_splits(spark, tmp_path, small_splits):
    one, two = records(40, 1), records(7, 2)
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(" \n" + json.dumps(two, indent=3, ensure_ascii=False) + "\n\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    df = load(spark, str(tmp_path), "json_array", schema=SCHEMA)
    assert told(df) == sorted(json.dumps(x, sort_keys=True) for x in one + two)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 10


def test_no_records_one_object_and_no_schema(spark, tmp_path):
    (tmp_path / "none.json").write_text("[ ]\n")
    assert load(spark, str(tmp_path / "none.json"), "json_array", schema=SCHEMA).count() == 0
    (tmp_path / "one.json").write_text('{"id": 3}')
    assert [r.id for r in load(spark, str(tmp_path / "one.json"), "json_array", schema=SCHEMA).collect()] == [3]
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id" 2}, {"id": 3}]')
    assert sorted(r.id or 0 for r in load(spark, str(tmp_path / "bad.json"), "json_array", schema=SCHEMA).collect()) == [0, 1, 3]
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "one.json"), "json_array")


def test_only_records_across_splits_are_dealt(spark, tmp_path):
    many = records(300, 3)
    (tmp_path / "a.json").write_text(json.dumps(many))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("8192", "0")):
            spark.conf.set(n, v)
        df = load(spark, str(tmp_path / "a.json"), "json_array", schema=SCHEMA)
        assert told(df) == sorted(json.dumps(x, sort_keys=True) for x in many)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert "Union" in plan and plan.count("Window") == 1  # records within a split meet no window and no group


def test_splits_that_begin_within_strings_unlike_they_seem(spark, tmp_path, small_splits):
    """No quote here tells a string's begin from its end by what follows it."""
    r = random.Random(4)
    many = [{":k": "," + "".join(r.choices(["x", "}", "{", ",", " "], k=r.randint(0, 150))), ",n": {":m": "]}"}} for _ in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(many))
    df = load(spark, str(tmp_path / "a.json"), "json_array", schema="`:k` string, `,n` struct<`:m`: string>")
    assert told(df) == sorted(json.dumps(x, sort_keys=True) for x in many)
