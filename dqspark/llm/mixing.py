"""Mixing sources to target weights along a curriculum whose weights change over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.llm.common import WORD, boxed, group_key, row_digest, running, seeded_order, unboxed

#: Rate of a source over the time of training, as (time, rate) joined by lines; one per weight in turn.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(groups: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``target`` and ``turn`` of each source (``g``, ``group_value``), one row each.

    Sources in order of their names, null last, take the weights in turn; targets are in proportion to
    them and share the sum of all sizes. None exceeds ``most`` times its source's size: in the order of
    size over weight, a source is capped as long as the level that the rest would get reaches its cap.
    """
    by_name = Window.orderBy(F.col("g") == "null", "g")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = F.lit(float(most)) * F.col("group_value")
    rest = Window.orderBy("ratio", "g")
    return groups.withColumn("turn", turn).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1),
        "cap": cap,
    }).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn(
        "level",
        (F.sum("group_value").over(Window.partitionBy())
         - F.coalesce(F.sum("cap").over(rest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(rest.rowsBetween(0, Window.unboundedFollowing)),
    ).withColumn("free", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "g", "level"))).withColumn(
        "target",
        F.least("cap", F.coalesce(F.min("free").over(Window.partitionBy()).getField("level") * F.col("weight"), "cap")),
    ).select("g", "turn", "target")


def when_demanded(share: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """The time by which a source's demand reaches ``share`` of its total: its integrated schedule inverted."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        pieces = [(t0, t1, r0, r1, (t1 - t0) * (r0 + r1) / 2) for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
        total, done, time = sum(p[-1] for p in pieces), 0.0, F.lit(float(knots[-1][0]))
        steps = []
        for t0, t1, r0, r1, area in pieces:
            left = F.greatest(share * total - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * left * ((r1 - r0) / (t1 - t0)), F.lit(0.0)))
            steps.append((done + area, F.lit(t0) + F.coalesce(F.try_divide(2 * left, F.lit(r0) + root), F.lit(0.0))))
            done += area
        for end, at in reversed(steps):
            time = F.when(share * total <= end, at).otherwise(time)
        out = F.when(turn == i, F.least(time, F.lit(float(knots[-1][0])))).otherwise(out)
    return out


def curriculum(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id",
               weights: Sequence[float] = (5, 2, 1), most: float = 3.0, schedules=SCHEDULES,
               whole: bool = False, seed: int = 8) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``taken`` and ``occurrences``.

    A source is read again and again in a seeded order until its target is reached. ``occurrences`` lists
    for each time a row is taken its ``epoch``, its ``words`` and its training ``position`` between 0 and
    1: the time at which the integrated schedule of the source has demanded what lies in front of the
    middle of the row. The last row of a source gives the words still missing, so that takes equal
    targets; with ``whole`` it is taken entirely if at least half of it is missing, else not at all.

    Null sources are one source, after the others. Rows of size 0 take nothing (with ``whole`` they are
    repeated as their source is). Null and repeated keys are ordered by a hash of the whole row. An empty table
    gives an empty one; columns with the names of new ones are replaced.
    """
    columns = df.columns
    rows = df.select(boxed(df), group_key(df[source]).alias("g"), size.cast("bigint").alias("size"),
                     seeded_order(df, key, seed).alias("h"), row_digest(df).alias("tie"))
    ranked, groups, _ = running(rows, ["tie"], "size")
    aimed = ranked.join(targets(groups, weights, most), "g").withColumn("source_size", F.col("group_value"))
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("bigint")
    aimed = aimed.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    if whole:
        last = F.when((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")), F.col("size"))
    else:
        part = F.least("size", F.greatest(F.lit(0), F.round("rest").cast("bigint") - F.col("before")))
        last = F.when(part > 0, part)
    aimed = aimed.withColumn("last", last)
    takes = F.transform(
        F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("full")),
                 lambda e: (e < F.col("full")) & (F.lit(whole) | (F.col("size") > 0)) | (e == F.col("full")) & F.col("last").isNotNull()),
        lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("full"), F.col("size")).otherwise(F.col("last")).alias("words")))
    placed = F.transform(takes, lambda x: F.struct(
        x["epoch"].alias("epoch"), x["words"].alias("words"),
        when_demanded(F.least(F.lit(1.0), F.coalesce(F.try_divide(
            x["epoch"] * F.col("source_size") + F.col("before") + x["words"] / 2, F.col("target")), F.lit(0.0))),
            F.col("turn"), schedules).alias("position")))
    taken = F.col("size") * F.col("full") + F.coalesce("last", F.lit(0))
    return unboxed(aimed.withColumn("taken", taken).withColumn("occurrences", placed),
                   columns, ["size", "source_size", "target", "taken", "occurrences"])


def training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each time a row is taken, range-sorted by ``position`` and key."""
    columns = [c for c in mixed.columns if c != "occurrences"]
    return mixed.select(*[mixed[c] for c in columns], F.inline("occurrences")).orderBy("position", key)
