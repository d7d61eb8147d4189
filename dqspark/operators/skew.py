"""Joins that stay balanced when one key holds much of the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dqspark.functions.values import named

HOT_ROWS = 100_000  # rows below which a key is no burden to one task
PARTS = 10_000      # a key with more than one of so many parts of the rows is split, into such parts


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str],
    counted: DataFrame | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` for inner, left, left_semi and left_anti joins.

    Left keys are counted first, summed in part before the shuffle. A key with more than its part of
    all rows goes to as many shares as it has parts: a left row to the one its ``spread_by`` columns
    hash to, a right row to every one. There are at most ``PARTS`` such keys, whatever the size of
    the tables, so they can be broadcast to mark both sides; other rows are left as they are. Left
    rows with a null key match nothing and are spread too. ``counted`` gives the rows per left key,
    as ``n``, where the caller has them already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot copy its right side")
    if counted is None:
        counted = left.groupBy(*[named(c) for c in on]).agg(F.count(F.lit(1)).alias("n"))
    part = F.greatest(F.lit(HOT_ROWS), (counted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar() / PARTS).cast("bigint") + 1)
    hot = counted.withColumn("__part", part).filter(F.col("n") > F.col("__part")).select(
        *[named(c) for c in on], F.ceil(F.col("n") / F.col("__part")).cast("int").alias("__shares"))
    spread = F.xxhash64(*[named(c) for c in spread_by])
    nowhere = F.lit(False)
    for c in on:
        nowhere = nowhere | named(c).isNull()
    marked_left = left.join(F.broadcast(hot), list(on), "left").withColumn(
        "__salt", F.when(nowhere, F.pmod(spread, F.lit(PARTS))).when(
            F.col("__shares").isNotNull(), F.pmod(spread, F.col("__shares"))).otherwise(0).cast("int")).drop("__shares")
    copies = F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1)
    marked_right = right.join(F.broadcast(hot), list(on), "left").withColumn("__salt", F.explode(copies)).drop("__shares")
    return marked_left.join(marked_right, [*on, "__salt"], how).drop("__salt")
