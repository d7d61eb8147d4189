"""Top-k search against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import hamming


def plain(rows, asked, k):
    out = set()
    for q, c in set(asked):
        if q is None or c is None:
            continue
        near = sorted({(bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in rows if i is not None and x is not None and i != q})
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("shard", (1, 100))
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hamming, "SHARD", shard)
    monkeypatch.setattr(hamming, "QUERIES_A_BLOCK", 9)
    r = np.random.default_rng(shard)
    base = r.integers(-2**63, 2**63 - 1, 5)
    rows = [(i, int(base[i % 5] ^ np.int64(sum(1 << int(b) for b in r.integers(0, 62, r.integers(0, 12)))))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), rows[3], (None, 5), (102, None)]
    df = spark.createDataFrame(rows, "vec_id long, code long").withColumn("rank", F.lit(0))
    asked = df.where("vec_id % 3 = 0 or vec_id is null")
    got = {tuple(x) for x in hamming.top_k(df, asked, k=5).collect()}
    assert got == plain(rows, [x for x in rows if x[0] is None or x[0] % 3 == 0], 5)


def test_few_rows_and_none(spark):
    two = spark.createDataFrame([(1, 0), (2, -1)], "vec_id long, code long")
    assert {tuple(x) for x in hamming.top_k(two, two, k=5).collect()} == {(1, 1, 2, 64), (2, 1, 1, 64)}
    assert hamming.top_k(two.limit(0), two.limit(0)).count() == 0


def test_codes_are_signs(spark):
    r = np.random.default_rng(1)
    vectors = [[float(x) for x in r.normal(size=64)] for _ in range(20)] + [[-1.0] * 64, [1.0] * 64, [0.0] * 64]
    df = spark.createDataFrame([(v,) for v in vectors + [None, [1.0], [None] * 64]], "v array<float>")
    got = [x.c for x in df.select(hamming.sign_code(F.col("v")).alias("c")).collect()]
    for v, c in zip(vectors, got):
        assert c & (2**64 - 1) == sum(1 << i for i, x in enumerate(v) if x > 0)
    assert got[-3:] == [None] * 3
