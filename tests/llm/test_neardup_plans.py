"""How much the driver plans for components: few exchanges in a round, no step without rows."""

import random

from dqspark.llm import neardup


def plans(monkeypatch):
    found, kept = [], neardup.keep

    def noted(df, purpose):
        found.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, purpose)

    monkeypatch.setattr(neardup, "keep", noted)
    return found


def test_a_round_of_components_joins_nothing(spark, monkeypatch):
    found = plans(monkeypatch)
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 300)]
    roots = neardup.components(spark.createDataFrame(links, "a long, b long"))
    want = {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)} | {200: 200, 300: 200}
    assert {r.sid: r.root for r in roots.collect()} == want
    rounds = [plan for purpose, plan in found if purpose == "edges"]
    assert len(rounds) > 2
    assert all("Join" not in plan and plan.count("Exchange ") <= 3 for plan in rounds)


def test_no_blocks_are_planned_without_sets_far_from_their_pivot(spark, monkeypatch):
    found = plans(monkeypatch)
    r = random.Random(4)
    base = [f"w{r.randrange(1000)}" for _ in range(200)]
    texts = [" ".join([*base[:i], "edited", *base[i + 1:]]) for i in (3, 50, 120)] + [" ".join(base)] * 2
    df = spark.createDataFrame([*enumerate(texts), (9, "quite another text than all of these")], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
    assert "checked" in dict(found) and "rest" not in dict(found)
