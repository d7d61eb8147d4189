"""Near-duplicates against all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dqspark.llm import neardup, queries

SF = "/root/testdata/sf0.001"


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def plain_components(rows, k, at_least):
    sets = plain_sets([t for _, t in rows], k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * both >= at_least * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [(len(sets[i]), low.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def varied(n, seed):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, at_least", ((3, 85), (5, 80)))
def test_components_equal_all_pairs(spark, k, at_least):
    rows = varied(40, k)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "É a b c"), (506, "é a b c"), rows[0], (None, rows[1][1]), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1)).withColumn("kept", F.lit("x"))
    got = neardup.near_duplicates(df, k, at_least).collect()
    want = dict(zip(rows, plain_components(rows, k, at_least)))
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_shingles, x.component_id) == want[(x.doc_id, x.text)]
        assert x.kept == (x.doc_id == x.component_id)
    left = neardup.one_of_each(df, k, at_least).collect()
    assert len(left) == len({c for (_, t), (n, c) in want.items() if n} - {None}) + 3 + 1  # texts without words, and the null key
    assert left[0].asDict().keys() == {"doc_id", "text", "sid", "kept"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0 and neardup.one_of_each(df).count() == 0


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS_A_BLOCK", 8)
    monkeypatch.setattr(neardup, "PAIRS_A_TASK", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, plain_components(rows, 3, 85))}


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: v for (k, _), v in zip(rows, plain_components(rows, 3, 85))}
    got = queries.QUERIES["op6_tensored_minhash"](spark, SF).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_chains_around_a_pivot_and_far_groups(spark):
    """Copies of copies, and groups that share tables with a pivot they do not resemble."""
    r = random.Random(4)
    rows, base = [], [f"w{i}" for i in range(90)]
    for _ in range(25):
        copy = list(base)
        for _ in range(r.randint(1, 6)):
            copy[r.randrange(90)] = f"x{r.randint(0, 99)}"
        rows.append((len(rows), " ".join(copy)))
        for _ in range(r.randint(0, 4)):  # copies of the copy
            for _ in range(2):
                copy[r.randrange(90)] = f"y{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(copy)))
    for g in range(6):
        mixed = base[:40 + 5 * g] + [f"g{g}_{i}" for i in range(60 - 5 * g)]
        for j in range(4):
            copy = list(mixed)
            copy[r.randrange(95)] = f"z{j}"
            rows.append((len(rows), " ".join(copy)))
    for k, at_least in ((3, 85), (3, 80), (1, 70)):
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, at_least).collect()}
        assert got == {i: c for (i, _), (_, c) in zip(rows, plain_components(rows, k, at_least))}


def test_settled_components_are_not_followed_again(spark, monkeypatch):
    rows, r = [], random.Random(9)
    for group in range(3):
        base = [f"w{group}x{i}" for i in range(200)]
        for i in range(5):
            copy = list(base)
            copy[r.randrange(200)] = f"new{group}{i}"
            rows.append((len(rows), " ".join(copy)))
    kept, plain = [], neardup.keep
    monkeypatch.setattr(neardup, "keep", lambda df, purpose: kept.append(purpose) or plain(df, purpose))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, plain_components(rows, 3, 85))}
    assert kept.count("edges") <= 3 and "members" not in kept and "left" not in kept, kept


def test_further_links_join_components(spark):
    links = lambda *pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = neardup.components(links((9, 8), (8, 7), (5, 6), (6, 9), (20, 21), (30, 31)))
    assert {tuple(x) for x in roots.collect()} == {(x, 5) for x in (5, 6, 7, 8, 9)} | {(20, 20), (21, 20), (30, 30), (31, 30)}
    roots = neardup.with_links(roots, links((8, 5), (21, 31), (40, 7), (50, 51)))
    assert {tuple(x) for x in roots.collect()} == {(x, 5) for x in (5, 6, 7, 8, 9, 40)} | {(x, 20) for x in (20, 21, 30, 31)} | {(50, 50), (51, 50)}
    assert roots is neardup.with_links(roots, links((9, 40), (31, 20)))
