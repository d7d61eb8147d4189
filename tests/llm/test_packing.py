"""Packing: first fit against a plain scan of the bins, whole round trips, no padding."""

import random
from collections import defaultdict

import numpy as np
import pytest

from dqspark.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
tokenizer, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, length string"


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = sorted((r.randint(1, 50) for _ in range(r.randint(0, 200))), reverse=True)
    free, want = [], []
    for n in lengths:
        bin_ = next((i for i, f in enumerate(free) if f >= n), len(free))
        if bin_ == len(free):
            free.append(50)
        free[bin_] -= n
        want.append(bin_)
    assert packing.first_fit(lengths, 50) == want


SIGNS = ["a", "Zé", "9", " ", "  ", "\t", "\n", "\r\n", "'s", "'re", "'LL", "!", "...", "_", "κ", "ж", "<|end", "\u00a0", "\u2003", "\u3000", "数",
         "<|endoftext|>", "\U0001f600", "\u200b", "\x1c", "\x85", "ß", "×", "²", "\u0301"]


@pytest.mark.parametrize("signs", [SIGNS, SIGNS[:17]])
def test_ranks_give_the_same_ids(signs):
    r = random.Random(len(signs))
    texts = ["".join(r.choices(signs + [" "] * 9, k=r.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * 20_000, " " * 20_000 + "b", "x<|endoftext|> y", "It's we'LL 12 345 x_1 é É ñandú Ωμέγα Ёж"]
    whole = tokenizers.Tokenizer.from_file(tokenizer)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.Encoder(tokenizer, ranks)(texts)] == want
    assert [x.tolist() for x in packing.Encoder(tokenizer)(texts)] == want
    assert sum(bool(packing.COMMON(t)) for t in texts) > 50


def encoded(text):
    return [*tokenizers.Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids, 1]


def check(got, docs, capacity):
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, ids, r.doc_tokens))
    for own in sequences.values():
        filled = 0
        for offset, length in sorted(own):
            assert offset == filled
            filled += length
        assert filled <= capacity and (filled == capacity or filled & (filled - 1) == 0)
    for key, text in {d[0]: d[1] for d in docs}.items():
        copies = sum(d[0] == key for d in docs)
        want = encoded(text)
        whole = sorted(seen[key], key=lambda p: p[0])
        assert sum(len(p[1]) for p in whole) == copies * len(want) and {p[2] for p in whole} == {len(want)}
        if copies == 1:
            assert [i for p in whole for i in p[1]] == want
        for start, ids, _ in whole:
            assert want[start:start + len(ids)] == ids
    return sequences


def test_round_trip_without_padding(spark):
    r = random.Random(3)
    docs = [(i, None if i % 13 == 5 else " ".join(r.choices(["tree", "é", "<|endoftext|>", "\n\n", "x1"], k=r.randint(0, 60))), "x")
            for i in range(150)] + [(1000, "long word " * 400, None)]
    got = packing.packed(spark.createDataFrame(docs, DOCS).repartition(3), tokenizer, capacity=64, ranks=ranks).collect()
    sequences = check(got, docs, 64)
    total = sum(len(encoded(d[1])) for d in docs)
    assert len(sequences) <= total // 64 + 7


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "one two three", None)] * 40 + [(2, None, None), (3, "", None)]
    got = packing.packed(spark.createDataFrame(docs, DOCS), tokenizer, capacity=32).collect()
    check(got, docs, 32)
    assert packing.packed(spark.createDataFrame([], DOCS), tokenizer).count() == 0


def test_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_GROUP", 20)
    docs = [(i, "w " * (i % 37), "x") for i in range(200)]
    got = packing.packed(spark.createDataFrame(docs, DOCS), tokenizer, capacity=48).collect()
    check(got, docs, 48)
    assert len({r.sequence_id >> 24 for r in got if r.sequence_id < 1 << 62}) > 3
