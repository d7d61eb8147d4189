"""Windows of event time fed piece by piece, and files that never come."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqspark import Metric
from dqspark.streaming import Windows, advance_overdue, advance_windows, overdue, window_metrics

SCHEMA = "id long, ts timestamp, k string, v long"


def feed(spark, path, rows):
    spark.createDataFrame(rows, "id long, t string, k string, v long").select(
        "id", F.col("t").cast("timestamp").alias("ts"), "k", "v").write.mode("append").parquet(path)


def day(hour, minute=0):
    return f"2024-01-01 {hour:02d}:{minute:02d}:00"


def test_late_and_untimed_rows_are_counted_apart(spark, tmp_path):
    path, sink = str(tmp_path / "in"), str(tmp_path / "out")
    metrics = [Metric("row_count", id="n"), Metric("max", id="top", column="v", where="v < 2000")]

    def advance():
        advance_windows(spark, path, metrics, Windows("1 hour"), sink, schema=SCHEMA, time="ts", keys=["k"], delay="30 minutes")

    def windows():
        return {(r.window_start.hour, r.k, r.metric_id): (r.value, r.exact) for r in spark.read.parquet(f"{sink}/windows").collect()}

    feed(spark, path, [(1, day(1), "a", 2**53 + 1), (2, day(1, 59), "a", 7), (3, day(3, 10), None, 9), (4, None, "a", 1)])
    advance()
    first = windows()
    assert first[1, "a", "n"] == (2.0, "2") and first[1, "a", "top"] == (7.0, "7") and not [k for k in first if k[0] == 3]
    feed(spark, path, [(5, day(1, 30), "a", 1), (6, day(2, 45), "a", 1), (7, day(5), "b", 1)])
    advance()
    advance()  # nothing new
    found = windows()
    assert found | first == found  # a window that was written stays as it is
    assert found[2, "a", "n"] == (1.0, "1") and found[3, None, "n"] == (1.0, "1") and (5, "b", "n") not in found
    arrivals = spark.read.parquet(f"{sink}/arrivals").agg(F.sum("accepted"), F.sum("late"), F.sum("untimed")).first()
    assert tuple(arrivals) == (5, 1, 1)
    assert [r.id for r in spark.read.parquet(f"{sink}/late").collect()] == [5]
    assert [r.id for r in spark.read.parquet(f"{sink}/untimed").collect()] == [4]


def test_windows_of_a_table(spark):
    rows = [(i, day(i % 5, 7 * i % 60), "ab"[i % 2], i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, k string, v long").withColumn("ts", F.col("t").cast("timestamp"))
    got = window_metrics(df, [Metric("row_count", id="n")], Windows("2 hours", "1 hour"), "ts").collect()
    assert sum(r.value for r in got) == 80
    sessions = window_metrics(df.where("k = 'a'"), [Metric("row_count", id="n")], Windows(gap="20 minutes"), "ts").collect()
    times = sorted(60 * (i % 5) + 7 * i % 60 for i in range(0, 40, 2))
    want, last = [], None
    for t in times:
        if last is None or t - last > 20:  # a session holds its end no more
            want.append(0)
        want[-1] += 1
        last = t
    assert Counter(r.value for r in sessions) == Counter(map(float, want))


def test_what_windows_refuse(spark):
    for bad in ({}, {"size": "1 hour", "gap": "1 hour"}, {"gap": "1 hour", "slide": "1 hour"}):
        with pytest.raises(ValueError):
            Windows(**bad)
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="no aggregate"):
        window_metrics(df, [Metric("duplicate_count", id="d", column="k")], Windows("1 hour"), "ts")


def test_overdue_files(spark, tmp_path):
    expected, arrived, sink = (str(tmp_path / n) for n in ("expected", "arrived", "out"))

    def land(path, rows, column):
        spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias(column)).write.mode("append").parquet(path)

    def advance():
        advance_overdue(spark, expected, arrived, sink, expected_schema="k string, due timestamp", arrived_schema="k string, at timestamp",
                        key=["k"], due="due", at="at", within="1 hour", early="30 minutes", delay="10 minutes")
        return sorted((r.k or "", r.due.hour, r.arrived_at and r.arrived_at.hour) for r in spark.read.parquet(f"{sink}/files").collect())

    land(expected, [("a", day(1)), ("b", day(1)), ("c", day(6)), (None, day(1))], "due")
    land(arrived, [("a", day(1, 20)), ("b", day(2, 30)), (None, day(1)), ("d", day(3))], "at")
    once = advance()
    assert once == [("", 1, None), ("a", 1, 1), ("b", 1, None)]  # b came too late, a null key names no file
    land(arrived, [("c", day(5, 45)), ("x", day(12))], "at")
    land(expected, [("e", day(8)), ("f", day(14))], "due")
    assert advance() == sorted(once + [("c", 6, 5), ("e", 8, None)])
    batch = overdue(*(spark.read.parquet(p) for p in (expected, arrived)), ["k"], "due", "at", "1 hour", "30 minutes")
    assert batch.count() == 6 and batch.where("arrived_at is null").count() == 4
