"""Resampling: CRCs of ranges against zlib, features, weights and ranks against a plain statement."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dqspark.llm import resampling
from dqspark.llm.crc import SIDE, Prefixes

DOCS = "doc_id long, text string, score string"
GOAL = "item_id long, text string"


@pytest.mark.parametrize("size", [0, 1, SIDE - 1, SIDE, SIDE + 1, 5000])
def test_crc_of_ranges(size):
    r = random.Random(size)
    raw = r.randbytes(size)
    found = Prefixes(np.frombuffer(raw, np.uint8))
    ranges = [tuple(sorted((r.randint(0, size), r.randint(0, size)))) for _ in range(300)] + [(0, size), (size, size)]
    first, end = (np.array(x) for x in zip(*ranges))
    assert found.crc32(first, end).tolist() == [zlib.crc32(raw[a:b]) for a, b in ranges]


def words(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def runs(text, longest):
    w = words(text)
    return [b" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, goal, longest, buckets, percent, least):
    own, wanted = (Counter(zlib.crc32(f) % buckets for t in texts for f in runs(t, longest)) for texts in ([d[1] for d in docs], goal))
    s, t = sum(own.values()), sum(wanted.values())
    out = []
    for key, text, _ in docs:
        feats = [zlib.crc32(f) % buckets for f in runs(text, longest)]
        weight = sum(math.floor(1000 * math.log(((wanted[b] + 1) * (s + buckets)) / ((own[b] + 1) * (t + buckets)))) for b in feats)
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(feats), weight, score, len(words(text)) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = fit[:percent * len(fit) // 100]
    return out, [(x[0], x[3]) for x in drawn]


def some(n, seed):
    r = random.Random(seed)
    vocabulary = ["Ab", "c1", "dé", "x_y", "Z", "ß", "9", "word", "κ", "no-no"]
    return [(i, None if i % 11 == 0 else " ".join(r.choices(vocabulary, k=r.randint(0, 30))) + r.choice(["", "\n", "  ."]), "x") for i in range(n)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 50)])
def test_all_rows_as_stated(spark, longest, buckets):
    docs = some(120, longest)
    goal = ["c1 word word κ", None, "", "dé c1"]
    got = resampling.resampled(
        spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(list(enumerate(goal)), GOAL),
        longest=longest, buckets=buckets, percent=30, least_words=8).collect()
    out, drawn = plain(docs, goal, longest, buckets, 30, 8)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == [tuple(x[:4]) for x in out]
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_nulls_repeats_and_empty(spark):
    goal = spark.createDataFrame([(1, "a b")], GOAL)
    docs = [(None, "a b c d", "x")] * 7 + [(3, "a b c d", "x")] * 3 + [(4, None, "x"), (5, "", None)]
    got = resampling.resampled(spark.createDataFrame(docs, DOCS), goal, percent=50, least_words=4, whole=True).collect()
    assert len(got) == 12 and Counter(r.text for r in got) == Counter(x[1] for x in docs)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert {(r.n_features, r.weight, r["rank"]) for r in got if not r.text} == {(0, 0, None)}
    assert all(isinstance(r.score, int) for r in got)  # in place of the input's column of that name
    assert resampling.resampled(spark.createDataFrame([], DOCS), goal).count() == 0
    assert resampling.resampled(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], GOAL)).count() == 12


def test_long_texts_and_words(spark):
    docs = [(1, "a" * 300_000 + " b " * 100_000, "x"), (2, "b", "x")]
    goal = spark.createDataFrame([(1, "b")], GOAL)
    got = {r.doc_id: r for r in resampling.resampled(spark.createDataFrame(docs, DOCS), goal, longest=2).collect()}
    assert got[1].n_features == 200_001 and got[2].n_features == 1
