"""Several suites over the same datasets: as if run one by one, but with one scan of each dataset."""

import pytest

from dqspark import run_suite, run_suites
from dqspark.operators.scan import long_values
from dqspark.plans import suite as suites

LIMITS = {
    "id": "limits", "keys": {"people": "id"},
    "metrics": [{"id": "minors", "type": "count_where", "dataset": "people", "filter": "age < 18"},
                {"id": "by_town", "type": "aggregation_by_column", "dataset": "people", "group_by": "town", "target": "age"},
                {"id": "wrong", "type": "avg", "dataset": "people", "column": "nowhere"}],
    "tests": [{"id": "adults", "type": "threshold", "metric": "minors", "operator": "<=", "value": 0},
              {"id": "age", "type": "interval_check", "dataset": "people", "columns": ["age"], "lower": 18, "where": "town = 'a'"},
              {"id": "old_towns", "type": "interval_check", "dataset": "virtual:by_town", "columns": ["sum_age"], "lower": 60}]}
# The same ids with other meanings, and a table of the same name.
OTHERS = {
    "id": "others", "keys": {"people": "id"},
    "metrics": [{"id": "minors", "type": "count_where", "dataset": "people", "filter": "age < 30"},
                {"id": "by_town", "type": "aggregation_by_column", "dataset": "people", "group_by": "town", "target": "id"}],
    "tests": [{"id": "adults", "type": "threshold", "metric": "minors", "operator": "<=", "value": 9},
              {"id": "age", "type": "interval_check", "dataset": "people", "columns": ["age"], "upper": 50, "where": "town = 'b'"},
              {"id": "towns_known", "type": "foreign_key", "dataset": "people", "column": "town", "ref": "towns.name"},
              {"id": "old_towns", "type": "interval_check", "dataset": "virtual:by_town", "columns": ["sum_id"], "upper": 5}]}


@pytest.fixture(scope="module")
def data(spark):
    return {"people": spark.createDataFrame([(1, "a", 17), (2, "a", 40), (3, "b", 70), (4, "c", 20)], "id int, town string, age int"),
            "towns": spark.createDataFrame([("a",), ("b",)], "name string")}


def told(result):
    keys = [c for c in result.tests.columns]
    samples = {t: sorted(map(tuple, df.collect())) for t, df in result.samples.items()}
    return ([tuple(r) for r in result.metrics.collect()], [tuple(r[c] for c in keys) for r in result.tests.collect()],
            sorted(map(tuple, result.details.collect())), sorted(map(tuple, result.investigations.collect())), samples,
            {a: sorted(map(tuple, df.collect()), key=str) for a, df in result.tables.items()})


def test_as_one_by_one(spark, data):
    together = run_suites(spark, data, [LIMITS, OTHERS])
    for suite, result in zip([LIMITS, OTHERS], together):
        assert told(result) == told(run_suite(spark, data, suite))
    assert {r.test_id: r.status for r in together[1].tests.collect()} == {
        "adults": "SUCCESS", "age": "FAIL", "towns_known": "FAIL", "old_towns": "SUCCESS"}
    assert {r.metric_id: r.status for r in together[0].metrics.collect()}["wrong"] == "ERROR"


def test_one_scan_of_a_dataset(spark, data, tmp_path, monkeypatch):
    data["people"].write.parquet(str(tmp_path / "people"))
    stored = {"people": spark.read.parquet(str(tmp_path / "people"))}
    few = [{"id": s["id"], "metrics": s["metrics"][:1], "tests": s["tests"][:1]} for s in (LIMITS, OTHERS)]
    asked, real = [], suites.collect_values
    monkeypatch.setattr(suites, "collect_values", lambda probes: asked.append(list(probes)) or real(probes))
    run_suites(spark, stored, few)
    assert [len(p) for p in asked] == [2, 0, 1, 0]
    plan = long_values(asked[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_suites_that_share_an_id_or_are_none(spark, data):
    with pytest.raises(ValueError):
        run_suites(spark, data, [LIMITS, LIMITS])
    assert run_suites(spark, data, []) == []
