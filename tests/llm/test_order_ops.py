"""Sharding, mixing, chat collapse and line deletion: small cases and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dqspark.llm import chat, common, lines, mixing, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, extra string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def some(n, seed=1, sources=("a", "b", None)):
    r = random.Random(seed)
    return [(i if i % 7 else None, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))) or None,
             r.choices(sources, (6, 2, 1, 1, 1)[:len(sources)])[0], "x") for i in range(n)]


def test_shards_are_even_and_show_the_mixture(spark):
    rows = some(300) + some(300)[:20]
    got = sharding.interleave(docs(spark, rows), shards=7).collect()
    assert Counter((r.doc_id, r.text, r.source, r.extra) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(7))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(x.slot for x in v) == list(range(len(v)))
        for source, n in Counter(x[2] for x in rows).items():
            assert abs(sum(x.source == source for x in v) - n / 7) <= 2


def test_interleaving_equals_the_sort_of_places(spark):
    rows = [(i, "t", "ab"[i % 3 == 0], "x") for i in range(60)]
    got = sharding.interleave(docs(spark, rows), shards=60).collect()
    place = {r.doc_id: r.shard for r in got}
    for s in "ab":
        own = sorted(place[i] for i, _, x, _ in rows if x == s)
        n = len(own)
        assert all(abs(p - (2 * r - 1) / (2 * n) * 60) <= 1.5 for r, p in enumerate(own, 1))
    assert {r.doc_id: r.shard for r in sharding.interleave(docs(spark, rows).repartition(5), shards=60).collect()} == place


def test_shards_of_empty_few_and_clashing(spark):
    assert sharding.interleave(docs(spark, [])).count() == 0
    two = docs(spark, [(1, None, None, "x"), (1, None, None, "x")]).withColumnRenamed("extra", "shard")
    assert sorted((r.shard, r.slot) for r in sharding.interleave(two).collect()) == [(0, 0), (4, 0)]


def test_sharding_query_covers_the_table(spark):
    got = queries.QUERIES["op2_stratified_sharding"](spark, SF).collect()
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(given)
    for r in got:
        raw = given[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        whole = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / whole > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / whole for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


@pytest.mark.parametrize("seed", range(3))
def test_takes_follow_targets(spark, seed):
    rows = some(200, seed, ("a", "b", "c", "d", None)[seed:])
    df = docs(spark, rows)
    got = mixing.curriculum(df, mixing.words(df["text"])).collect()
    sizes = Counter()
    for _, text, s, _ in rows:
        sizes[s] += len((text or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and r.taken == sum(o.words for o in r.occurrences)
        assert all(0 <= o.position <= 1 for o in r.occurrences)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.curriculum(df.repartition(3), mixing.words(df["text"])).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in got) == Counter((r.doc_id, r.text, r.taken) for r in again)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 5, "a", "x") for i in range(400)]
    df = docs(spark, rows)
    mixed = mixing.curriculum(df, mixing.words(df["text"]), schedules=(((0.0, 2.0), (1.0, 0.0)),))
    order = [r.position for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and len(order) == 400
    assert abs(sum(p <= 0.5 for p in order) - 300) <= 2  # the integral of 2 - 2t up to one half is 3/4


def test_whole_documents_and_empty_table(spark):
    df = docs(spark, some(120, 5))
    for r in mixing.curriculum(df, mixing.words(df["text"]), whole=True).collect():
        assert all(o.words == r.size for o in r.occurrences)
    empty = docs(spark, [])
    assert mixing.curriculum(empty, mixing.words(empty["text"])).count() == 0


def plain_maximal(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        said[c].append((turn is not None, turn or 0, role or "", role, text or "", text))
    whole = defaultdict(list)
    for c, turns in said.items():
        whole[tuple((t[3], t[5]) for t in sorted(turns, key=lambda t: t[:3] + (t[4],)))].append(c)
    begun = {k[:i] for k in whole for i in range(1, len(k))}
    return {min(v, key=lambda c: (c is None, c or 0)): (len(k), len(v)) for k, v in whole.items() if k not in begun}


def test_only_maximal_conversations_stay(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(120), None]:
        n = r.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", r.choice(("hi", "ho", None)) if t else "start") for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit(1))
    got = chat.render_maximal(df, turns_a_part=2)
    assert {x.conv_id: (x.n_turns, x.copies) for x in got.collect()} == plain_maximal(rows)
    for x in got.collect():
        assert x.chat.count("<|end|>") == min(2, x.n_turns - 2 * x.part)
    assert chat.render_maximal(df.limit(0)).count() == 0


def test_long_conversations_are_ranked_by_ranges(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(700)] + [(2, t, "user", f"t{t}") for t in range(600)]
    rows += [(3, None, None, None), (3, 1, "user", "x")]
    got = chat.render_maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("conv_id = 2").count() == 0
    text = "".join(r.chat for r in got.where("conv_id = 1").orderBy("part").collect())
    assert text == "".join(f"<|user|>\nt{t}<|end|>\n" for t in range(700))
    assert [r.chat for r in got.where("conv_id = 3").collect()] == ["<||>\n<|end|>\n<|user|>\nx<|end|>\n"]


def plain_lines(rows, w):
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[key] = None
            continue
        ls = text.split("\n")
        full = [i for i, x in enumerate(ls) if x.strip(" ")]
        gone = set()
        for s in range(len(full) - w + 1):
            run = tuple(ls[i] for i in full[s:s + w])
            if run in seen:
                gone |= set(range(full[s], full[s + w - 1] + 1))
            seen.add(run)
        out[key] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


@pytest.mark.parametrize("w", (1, 2, 4))
def test_later_runs_go(spark, w):
    r = random.Random(w)
    rows = [(i, "\n".join(r.choice(("a", "b", "c", "", " ", "long line")) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a\nb\nc\na"), rows[3]]
    got = lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)), min_lines=w)
    want = plain_lines(rows, w)
    for x in got.collect():
        assert x.kept_text == want[x.doc_id], x
        assert x.n_removed == len(x.removed)
    assert got.count() == len(rows)
    assert lines.drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_null_text_is_no_other_text(spark):
    turns = [(1, 1, "user", None), (2, 1, "user", "\0"), (2, 2, "user", "x"), (3, 1, None, "y"), (4, 1, "y", None), (4, 2, "y", "z")]
    kept = chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted(r.conv_id for r in kept.collect()) == [1, 2, 3, 4]


def largest_range(ranked):
    return ranked.agg(F.max("n")).first()[0]


def test_rows_without_a_key_are_spread(spark):
    rows = docs(spark, [(None if i % 2 else i, f"text {i}", "a", "x") for i in range(4000)])
    hashed = rows.select(F.lit("g").alias("g"), common.seeded_order(rows, "doc_id", 2).alias("h"))
    share = F.shiftrightunsigned("h", 1) / F.lit(float(2**63))
    assert largest_range(hashed.groupBy(F.floor(share * 63)).agg(F.count("*").alias("n"))) < 130
    got = sharding.interleave(rows, shards=8)
    assert Counter(r.shard for r in got.collect()) == {i: 500 for i in range(8)}


def test_as_many_sources_as_rows(spark):
    rows = docs(spark, [(i, "t", f"s{i % 1900}", "x") for i in range(2000)])
    got = sharding.interleave(rows, shards=8).collect()
    assert Counter(r.shard for r in got) == {i: 250 for i in range(8)}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(8) for i in range(250)]


def test_turns_without_id_or_number_are_cut(spark):
    turns = [(None, i % 3, "user", f"said {i}") for i in range(1500)] + [(1, None, "user", f"said {i}") for i in range(1500)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    placed = chat._placed(chat._turns(df, "conv_id", "turn", "role", "text"))
    assert largest_range(placed.groupBy("c", "range").agg(F.count("*").alias("n"))) < 20
    for c, n in ((None, 1500), (1, 1500)):
        mine = placed.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("k").collect()
        assert [x.k for x in mine] == list(range(1, n + 1)) and {x.n for x in mine} == {n}
        order = [(x.turn if x.turn is not None else -1, x.role, x.digest) for x in mine]
        assert order == sorted(order)
