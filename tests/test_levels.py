"""Levels of keys and differences of deliveries against plain statements."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from dqspark import Metric
from dqspark.operators.difference import difference, row_key
from dqspark.operators.levels import metric_levels


def test_cube_and_sets_against_counting(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, h int, v int")
    metrics = [Metric("row_count", id="n"), Metric("sum", id="sum", column="v"), Metric("min", id="min", column="v", where="v > 3")]
    want = {}
    for size in (0, 1, 2):
        for kept in combinations((0, 1), size):
            level = sum(2 ** (1 - i) for i in (0, 1) if i not in kept)
            for row in rows:
                at = (*[row[i] if i in kept else None for i in (0, 1)], level)
                want.setdefault(at, []).append(row[2])
    got = {}
    for x in metric_levels(df, metrics, ["g", "h"], "cube").collect():
        got.setdefault((x.g, x.h, x.level), {})[x.metric_id] = x.value
    assert got == {k: {"n": len(v), "sum": sum(v), "min": min((x for x in v if x > 3), default=None)} for k, v in want.items()}
    sets = metric_levels(df, metrics[:1], ["g", "h"], [["h"], []]).collect()
    assert {(x.h, x.level, x.value) for x in sets} == {(h, level, got[g, h, level]["n"]) for g, h, level in got if level in (2, 3)}
    rolled = metric_levels(df, metrics[:1], ["g", "h"]).collect()
    assert {x.level for x in rolled} == {0, 1, 3}


def test_what_levels_refuse(spark):
    df = spark.createDataFrame([], "g string, v int")
    for levels in ("all", [["x"]]):
        with pytest.raises(ValueError):
            metric_levels(df, [Metric("row_count", id="n")], ["g"], levels)
    with pytest.raises(ValueError):
        metric_levels(df, [Metric("duplicate_count", id="d", columns=["v"])], ["g"])
    assert metric_levels(df, [Metric("row_count", id="n")], ["g"]).where("level = 0").count() == 0


def plain(before, after):
    a, b = Counter(before), Counter(after)
    gone, come = a - b, b - a
    pairs = {k for k in {r[0] for r in gone} if k is not None
             and sum(n for r, n in gone.items() if r[0] == k) == 1 == sum(n for r, n in come.items() if r[0] == k)}
    out = Counter()
    for kind, side in (("removed", gone), ("added", come)):
        for row, n in side.items():
            if row[0] not in pairs:
                out[kind, n, row] += 1
    for k in pairs:
        out["changed", next(r for r in gone if r[0] == k), next(r for r in come if r[0] == k)] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_against_counters(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(12)]), r.choice([None, "x", "y", ""]), r.choice([None, 0.5, 1.5])) for _ in range(60)]
    before, after = rows[:45], rows[20:] + rows[:3]
    schema = "k int, t string, v double"
    got = Counter()
    for x in difference(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema).withColumn("more", F.lit(1)), "k").collect():
        if x.kind == "changed":
            got["changed", tuple(x.before), tuple(x.after)] += 1
            assert x.changed == [c for c in ("k", "t", "v") if x.before[c] != x.after[c]] and x.n == 1
        else:
            got[x.kind, x.n, tuple(x.before or x.after)] += 1
    assert got == plain(before, after)


def test_odd_cells_and_tables(spark):
    df = spark.createDataFrame([("a", "b:"), ("ab", ":"), (None, "-"), ("-", None), ("", None), (None, "")], "x string, y string")
    assert df.select(row_key(df, ["x", "y"]).alias("d")).distinct().count() == 6
    assert difference(df, df, ["x"]).count() == difference(df.limit(0), df.limit(0), "x").count() == 0
    assert difference(df.limit(0), df, "x").where("kind = 'added'").count() == 6
    with pytest.raises(KeyError):
        difference(df, df.drop("x"), "x")
