"""Order within keys against plain loops, with ranges of a few rows, so that every key lies across many."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dqspark import Metric, run_suite
from dqspark.operators import as_of, balances, compute_metrics, merged_periods, metric_details, ordered, orphans_at, overlaps, trailing

EVER, OPEN = -10**9, 10**9


@pytest.fixture(autouse=True)
def short_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 9)


def sorted_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    for group in groups.values():
        group.sort(key=lambda x: (x[1] is not None, x[1] or 0, x[3]))
    return groups


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(20)]), r.choice([None, *range(-5, 6)]), i) for i in range(120)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, v int, i int")


@pytest.mark.parametrize("n", [1, 3, 25])  # the last one looks back over several ranges
def test_frames_across_edges(frame, rows, n):
    got = trailing(frame, "g", ["t", "i"], n, lambda w: {
        "far": F.lag("i", n).over(w), "total": F.sum("v").over(w.rowsBetween(-n, -1)), "rows": F.count("i").over(w.rowsBetween(-n, 0))})
    want = set()
    for group in sorted_groups(rows).values():
        for j, row in enumerate(group):
            before = group[max(0, j - n):j]
            values = [x[2] for x in before if x[2] is not None]
            want.add((*row, before[0][3] if j >= n else None, sum(values) if values else None, len(before) + 1))
    assert {tuple(x) for x in got.collect()} == want
    assert got.columns == ["g", "t", "v", "i", "far", "total", "rows"]


def test_balances(frame, rows):
    want = set()
    for group in sorted_groups(rows).values():
        total = 0
        for row in group:
            total += row[2] or 0
            want.add((*row, total))
    assert {tuple(x) for x in balances(frame, "g", ["t", "i"], "v").collect()} == want


def test_balance_of_large_integers_is_exact(spark):
    df = spark.createDataFrame([(1, 2**63 - 1), (2, 2**63 - 1), (3, 1)], "t int, v bigint")
    assert [int(x.balance) for x in balances(df, [], "t", "v").orderBy("t").collect()] == [2**63 - 1, 2**64 - 2, 2**64 - 1]


def test_a_key_whose_rows_agree_is_cut(spark):
    same = spark.range(500).selectExpr("'k' as g", "1 as t", "id")
    assert ordered.in_ranges(same, ["g"], ["t"]).groupBy(ordered.PART).count().agg(F.max("count")).first()[0] < 60
    last = balances(same.withColumn("one", F.lit(1)), "g", "t", "one").agg(F.max("balance"), F.countDistinct("balance")).first()
    assert [int(x) for x in last] == [500, 500]


def test_latest_version(spark, frame, rows):
    r = random.Random(2)
    versions = [(r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(20)]), i) for i in range(60)]
    got = as_of(frame, spark.createDataFrame(versions, "k string, since int, id int"), "g", "t", "since", "k").collect()
    assert sorted(x.i for x in got) == [x[3] for x in rows]
    for x in got:
        known = [v for v in versions if None not in (x.g, x.t, v[1]) and v[0] == x.g and v[1] <= x.t]
        if known:
            assert tuple(x.version) in known and x.version.since == max(v[1] for v in known)
        else:
            assert x.version is None


def test_references_at_a_time(spark):
    ref = spark.createDataFrame([("a", 5, 8), ("a", 10, None), ("b", 1, 2), (None, 0, None)], "k string, since int, until int")
    df = spark.createDataFrame([("a", 4), ("a", 5), ("a", 7), ("a", 8), ("a", 10), ("a", 99), ("b", 2), ("c", 5), (None, 5), ("a", None)], "k string, at int")
    assert {tuple(x) for x in orphans_at(df, ["k"], "at", ref, "since", "until").collect()} == {
        ("a", 4), ("a", 8), ("b", 2), ("c", 5), ("a", None)}
    assert {tuple(x) for x in orphans_at(df, ["k"], "at", ref, "since").collect()} == {("a", 4), ("c", 5), ("a", None)}


def periods():
    r = random.Random(3)
    made = []
    for _ in range(150):
        start = r.choice([None, *range(40)])
        made.append((r.choice(["a", "a", "a", "b", None]), start, r.choice([None, *range(40)]) if start is None or r.random() < .1 else start + r.randint(-1, 4)))
    return [*made, ("z", None, 3), ("z", None, 9), ("z", 9, 10), ("z", 11, 12), ("y", 1, 1)]


def bounds(row):
    return EVER if row[1] is None else row[1], OPEN if row[2] is None else row[2]


def test_overlaps(spark):
    valid = [x for x in periods() if bounds(x)[1] > bounds(x)[0]]
    want = {}
    for i, x in enumerate(valid):
        (s, e), others = bounds(x), [y for j, y in enumerate(valid) if j != i and y[0] == x[0]]
        want[x] = valid.count(x), sum(bounds(y)[0] < e and s < bounds(y)[1] for y in others)
    got = overlaps(spark.createDataFrame(periods(), "g string, s int, e int"), "g", "s", "e").collect()
    assert {(x.g, x.s, x.e): (x.n_rows, x.n_overlaps) for x in got} == want


@pytest.mark.parametrize("touching", [True, False])
def test_merged_periods(spark, touching):
    few = [x for x in periods() if x[2] is not None or x[0] != "a"]
    want = []
    for g in {x[0] for x in few}:
        mine = sorted(bounds(x) for x in few if x[0] == g and bounds(x)[1] > bounds(x)[0])
        stretches = []
        for s, e in mine:
            if stretches and (s < stretches[-1][1] or touching and s == stretches[-1][1]):
                stretches[-1][1:] = max(e, stretches[-1][1]), stretches[-1][2] + 1
            else:
                stretches.append([s, e, 1])
        want += [(g, *x) for x in stretches]
    got = merged_periods(spark.createDataFrame(few, "g string, s int, e int"), "g", "s", "e", touching).collect()
    assert sorted(((x.g, *bounds(x[:3]), x.n_rows) for x in got), key=str) == sorted(want, key=str)


def test_empty_tables_and_clashing_names(spark, frame):
    nothing = frame.limit(0)
    assert trailing(nothing, "g", "t", 2, lambda w: {"x": F.lag("v").over(w)}).count() == 0
    assert balances(nothing, "g", "t", "v").count() == overlaps(nothing, "g", "t", "v").count() == merged_periods(nothing, "g", "t", "v").count() == 0
    assert as_of(frame, nothing, "g", "t", "t").where("version is null").count() == frame.count()
    for call in (lambda: balances(frame, "g", "t", "v", "V"), lambda: as_of(frame, frame, "g", "t", "t", name="i"),
                 lambda: trailing(frame, "g", "t", 1, lambda w: {"t": F.lag("v").over(w)}), lambda: trailing(frame, "g", "t", 0, lambda w: {})):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        balances(frame, "g", "nowhere", "v")


def test_metrics_in_a_suite(spark):
    # Planted: a gap of two hours, one of a day, one reading of 900, a payment too large, two readings that overlap, no price before the first day.
    readings = spark.createDataFrame([
        ("m", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 10.0, 5), ("m", "2024-01-01 02:00:00", "2024-01-01 03:30:00", 11.0, -4),
        ("m", "2024-01-01 03:00:00", "2024-01-01 04:00:00", 900.0, -3), ("m", "2024-01-02 03:00:00", "2024-01-02 04:00:00", None, 9),
        ("m", None, None, 1.0, None)], "meter string, t string, u string, v double, paid int").selectExpr(
            "meter", "cast(t as timestamp) t", "cast(u as timestamp) u", "v", "paid")
    prices = spark.createDataFrame([("m", "2024-01-01 01:30:00")], "meter string, since string").selectExpr("meter", "cast(since as timestamp) since")
    metrics = [
        {"id": "gaps", "type": "gap_count", "by": "meter", "order": "t", "longest": 3600},
        {"id": "jumps", "type": "jump_count", "by": "meter", "order": "t", "column": "v", "n": 2, "tolerance": 100},
        {"id": "overdrawn", "type": "balance_breaches", "by": "meter", "order": "t", "column": "paid", "lower": 0},
        {"id": "overlaps", "type": "overlap_count", "by": "meter", "start": "t", "end": "u", "where": "t is not null"},
        {"id": "unpriced", "type": "orphan_count_at", "column": "meter", "at": "t", "ref": "prices", "ref_since": "since"}]
    result = run_suite(spark, {"readings": readings, "prices": prices}, {
        "id": "s", "metrics": [{**m, "dataset": "readings"} for m in metrics],
        "tests": [{"id": "no_gap", "type": "threshold", "metric": "gaps", "operator": "<=", "value": 0}]})
    got = {x.metric_id: x.value for x in result.metrics.collect()}
    assert got == {"gaps": 2, "jumps": 1, "overdrawn": 1, "overlaps": 2, "unpriced": 2}
    assert [x.status for x in result.tests.collect()] == ["FAIL"]
    assert metric_details(readings, Metric("gap_count", by="meter", order="t", longest=3600)).first().longest == 24 * 3600
    with pytest.raises(ValueError):
        compute_metrics(readings, [Metric("balance_breaches", by="meter", order="t", column="paid")])
    with pytest.raises(ValueError):
        compute_metrics(readings, [Metric("gap_count", by="meter", order="t", longest=0)])
