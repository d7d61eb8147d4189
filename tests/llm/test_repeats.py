"""Repeated strings against a count of all strings; suffix arrays and common prefixes against sorting."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqspark.llm import queries, repeats, suffix

SF = "/root/testdata/sf0.001"


def plain(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i:i + n]) for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone, until = [], -1
        for i in range(len(r) - n + 1):
            if seen[hash(r[i:i + n])] > 1:
                if i > until:
                    gone.append([i, i + n])
                gone[-1][1] = until = i + n
        kept = r
        for a, b in reversed(gone):
            kept = kept[:a] + kept[b:]
        out.append((len(r), len(r) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(1)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 8))]
        parts += [parts[0]] * r.randint(0, 2)
        text, begins, left = suffix.joined(parts)
        most = r.randint(8, 40)
        sa = suffix.suffix_array(text, left)
        shared = suffix.common_prefixes(text, begins, left, sa, most)
        own = [bytes(text[i:i + left[i]]) for i in sa]
        assert sorted(sa) == list(range(len(text))) and own == sorted(own)
        for k in range(1, len(sa)):
            same = next((c for c in range(min(len(own[k - 1]), len(own[k]))) if own[k - 1][c] != own[k][c]), min(len(own[k - 1]), len(own[k])))
            assert shared[k] == min(same, most)


def test_segments_cover_every_start():
    r = random.Random(2)
    for text in (b"a" * 500, bytes(r.randrange(256) for _ in range(900)), b"ab " * 300, b"x" * 40):
        parts = repeats.segments(text, 60)
        assert [i for _, a, b, _ in parts for i in range(a, b + 1)] == list(range(max(0, len(text) - 59)))


@pytest.mark.parametrize("shard_bytes", (300, 10**6))
def test_removal_equals_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(repeats, "CLASSES_A_RANGE", 40)
    r = random.Random(shard_bytes)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    short = " ".join(word() for _ in range(9))[:58]
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(20)]
    texts += [" ".join([word(), word(), passage[r.randint(0, 50):], word(), word()]) for _ in range(25)]
    texts += [" ".join([word(), word(), short, word(), word(), word()]) for _ in range(30)]
    texts += [texts[21]] * 3 + [None, "", "z" * 400, "ab " * 90, "z" * 59, "z" * 60]
    rows = list(enumerate(texts)) + [(None, texts[22]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("rid", F.lit(2))
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in repeats.drop_repeats(df, length=60).collect())
    want = Counter((k, *x) for (k, _), x in zip(rows, plain([t for _, t in rows], 60)))
    assert got == want


def test_empty_table(spark):
    assert repeats.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(k, *x) for (k, _), x in zip(rows, plain([t for _, t in rows], 400))}
    got = {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in queries.QUERIES["op4_suffix_repeats"](spark, SF).collect()}
    assert got == want


def test_a_short_length_is_refused(spark):
    with pytest.raises(ValueError, match="at least"):
        repeats.drop_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=31)
