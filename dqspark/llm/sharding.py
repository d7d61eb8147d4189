"""Proportional stratified interleaving: shards of equal size that all show the same mixture."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.llm.common import boxed, group_key, row_digest, running, seeded_order, unboxed


def interleave(df: DataFrame, source: str = "source", key: str = "doc_id", shards: int = 8,
               seed: int = 2) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps).

    The rows of each source are ranked in a seeded order; rank r of n stands at (2r - 1) / 2n between 0
    and 1; all rows are put in the order of these places, which spreads every source evenly, and the
    order is cut into ``shards`` runs. Shards differ by at most one row, and a source differs by at most
    two rows from its share of a shard.

    No group is ranked in one task. Ranks come from ranges of a seeded hash of the key and the row; for the
    order of all rows the line from 0 to 1 is cut into ranges too, as many as the root of the number of
    rows, and how many rows of a source lie in front of a cut follows from its number of rows alone, so that
    sources of one size are one row, however many there are.

    A null source is a source. Null and repeated keys are ranked like others, equal rows in any order; rows
    equal in every column have one hash and are ranked side by side, in one range.
    An empty table gives an empty one. Columns named shard or slot are replaced.
    """
    columns = df.columns
    rows = df.select(boxed(df), group_key(df[source]).alias("g"),
                     seeded_order(df, key, seed).alias("h"), row_digest(df).alias("tie"))
    ranked, groups, n = running(rows, ["tie"])
    cuts = max(1, math.isqrt(n))
    # place * cuts, rounded down, in whole numbers
    twice = 2 * F.col("rank") - 1
    placed = ranked.withColumn("cut", F.expr(f"((2 * rank - 1) * {cuts}L) div (2 * group_rows)"))
    # rows in front of a cut follow from the size of a source alone: sources of one size, fewer than 2 * cuts sizes, count as one
    sizes = groups.groupBy("group_rows").agg(F.count("*").alias("alike"))
    ahead = sizes.select("group_rows", "alike", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)).cast("array<bigint>")).alias("cut")) \
        .groupBy("cut").agg(F.sum(F.expr(f"alike * ((2 * group_rows * cut + {cuts}L - 1) div (2 * {cuts}L))")).alias("ahead"))
    line = Window.partitionBy("cut").orderBy(twice / (2 * F.col("group_rows")), "g", "h", "tie")
    position = F.col("ahead") + F.row_number().over(line) - 1
    out = placed.join(ahead, "cut").withColumn("position", position)
    total = max(n, 1)
    return unboxed(out.withColumn("shard", F.expr(f"(position * {shards}L) div {total}L").cast("int"))
                   .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards}L - 1) div {shards}L")),
                   columns, ["shard", "slot"])


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
