"""Anchors dealt over several shards: rows follow where segments differ, not each of their strings."""

import random
from collections import Counter

import pytest

from dqspark.llm import repeats
from test_repeats import plain


def near_copies(r, copies, words=220):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    base = [word() for _ in range(words)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(5)]
    for i in range(copies):
        edited = list(base)
        for _ in range(1 + i % 3):
            edited[r.randrange(words)] = word()
        texts.append(" ".join(edited[r.randint(0, 40):]))
    return texts + texts[-3:] + ["ab " * 300, "ab " * 250, "z" * 700, None, ""]


@pytest.mark.parametrize("at_once", (0, 10**6))
@pytest.mark.parametrize("length", (60, 400))
def test_near_copies_of_split_anchors_equal_brute_force(spark, monkeypatch, length, at_once):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    monkeypatch.setattr(repeats, "CLASSES_A_RANGE", at_once)
    rows = list(enumerate(near_copies(random.Random(length), 50)))
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256)
                  for x in repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, plain([t for _, t in rows], length)))


def test_rows_of_split_anchors_are_fewer_than_their_strings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(repeats, "CLASSES_A_RANGE", 0)
    sizes, kept = Counter(), repeats.keep

    def counted(df, purpose):
        out = kept(df, purpose)
        sizes[purpose] = max(sizes[purpose], out.count())
        return out

    monkeypatch.setattr(repeats, "keep", counted)
    texts = near_copies(random.Random(9), 150)
    strings = sum(len({t[i:i + 400] for i in range(len(t) - 399)}) for t in texts if t)
    repeats.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=400).count()
    assert sizes["found"] <= 2 * sizes["distinct"]
    assert max(sizes.values()) < strings / 8
    assert sizes["ranges"] > 0
