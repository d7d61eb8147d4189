"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import keep

BITS, SEGMENTS = 64, 4
SEGMENT_BITS = BITS // SEGMENTS
SHARD = 16                 # codes indexed together, as a multiple of the root of their number
QUERIES_A_BLOCK = 2_000    # queries answered together


def sign_code(vector: Column) -> Column:
    """The signs of 64 numbers as a long: bit i is set if number i is above zero. Null for other vectors."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    whole = (F.size(vector) == BITS) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    # two halves of 32 bits, so that no sum overflows
    half = [F.aggregate(F.reverse(F.slice(bits, s, BITS // 2)), F.expr("0L"), lambda acc, x: acc * 2 + x) for s in (BITS // 2 + 1, 1)]
    high = F.when(half[0] >= 2**31, half[0] - 2**32).otherwise(half[0])
    return F.when(whole, high * 2**32 + half[1])


def _spheres() -> list[np.ndarray]:
    """For each radius the segment values with as many bits set."""
    out = []
    for r in range(SEGMENT_BITS + 1):
        out.append(np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), r)], dtype=np.uint16))
    return out


def parts(codes: np.ndarray) -> np.ndarray:
    """The segments of codes, one row each."""
    return np.stack([(codes >> np.uint64(SEGMENT_BITS * m)).astype(np.uint16) for m in range(SEGMENTS)])


class Index:
    """Codes by the values of their segments: for each segment an order and where each value begins."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.order, self.begin = [], []
        for seg in parts(codes):
            order = np.argsort(seg, kind="stable")
            self.order.append(order)
            self.begin.append(np.searchsorted(seg[order], np.arange(2**SEGMENT_BITS + 1)))

    def nearest(self, own: int, code: np.uint64, k: int, spheres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest ids other than ``own`` and their distances, ties by id.

        All segments are probed at growing radii. Once radius r is done, a code not met differs by at
        least r + 1 in each segment, hence by ``SEGMENTS`` * (r + 1) in all: when the k-th verified
        distance is smaller than that, no other code can matter.
        """
        mine = parts(np.array([code]))[:, 0]
        met = np.zeros(len(self.ids), bool)
        found_id, found_d = np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(SEGMENT_BITS + 1):
            rows = []
            for m in range(SEGMENTS):
                values = mine[m] ^ spheres[r]
                lo, n = self.begin[m][values], self.begin[m][values.astype(np.int64) + 1] - self.begin[m][values]
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    rows.append(self.order[m][at])
            if rows:
                new = np.unique(np.concatenate(rows))
                new = new[~met[new]]
                met[new] = True
                new = new[self.ids[new] != own]
                d = np.bitwise_count(self.codes[new] ^ code).astype(np.int64)
                found_id, found_d = np.r_[found_id, self.ids[new]], np.r_[found_d, d]
                best = np.lexsort((found_id, found_d))[:k]
                found_id, found_d = found_id[best], found_d[best]
            if len(found_d) == k and found_d[-1] < SEGMENTS * (r + 1):
                break
        return found_id, found_d


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", code: str = "code") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``neighbour_id`` and ``distance`` of the k nearest codes by Hamming distance.

    Codes are dealt into shards by a hash, more and larger ones the more there are, every shard is indexed once for each block of queries, answers
    each query exactly by growing segment radii, and the shards' answers are merged: a query's k nearest
    are among the k nearest of each shard. Ties go to the smaller id; a row is not its own neighbour, nor
    are rows of the same id. Repeated rows of one id and code count once. Rows without id or code are
    neither searched nor found; fewer than k other rows give fewer neighbours. Extra columns are not read.
    """
    known = keep(rows.where(rows[key].isNotNull() & rows[code].isNotNull()).select(rows[key].alias("id"), rows[code].alias("code")).distinct(), "codes")
    asked = keep(queries.where(queries[key].isNotNull() & queries[code].isNotNull()).select(queries[key].alias("id"), queries[code].alias("code")).distinct(), "asked")
    n = known.count()
    shards = max(1, math.ceil(n / (SHARD * math.isqrt(n) + 1)))
    blocks = max(1, math.ceil(asked.count() / QUERIES_A_BLOCK))
    index = known.select(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(shards)).cast("int").alias("shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "code")
    search = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                          F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(blocks)).cast("int").alias("block"), "id", "code")
    spheres = _spheres()

    def answer(own: pa.Table, asked_: pa.Table) -> pa.Table:
        ids, codes = np.array(own.column("id"), np.int64), np.array(own.column("code"), np.int64).view(np.uint64)
        order = np.argsort(ids, kind="stable")
        found = Index(ids[order], codes[order])
        out = [[], [], []]
        for q, c in zip(asked_.column("id").to_pylist(), np.array(asked_.column("code"), np.int64).view(np.uint64)):
            near, d = found.nearest(q, c, k, spheres)
            for col, x in zip(out, (np.full(len(near), q), near, d)):
                col.append(x)
        return pa.table({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in zip(("query_id", "neighbour_id", "distance"), out)})

    # little to read but much to do: as many partitions as groups, which are not put together for their size
    dealt = [side.repartition(shards * blocks, "shard", "block").groupBy("shard", "block") for side in (index, search)]
    local = dealt[0].cogroup(dealt[1]).applyInArrow(
        answer, "query_id long, neighbour_id long, distance long")
    best = local.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour_id"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.distance").cast("int").alias("distance"))
