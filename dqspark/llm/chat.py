"""Cumulative-snapshot collapse of logged conversations, and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dqspark.llm.common import group_key

TURNS_A_RANGE = 256  # turns ranked together; longer conversations are ranked range by range
TURNS_A_PART = 64    # turns rendered into one text


def _one():
    return Window.partitionBy("c", "range").orderBy(F.asc_nulls_first("turn"), "role", "digest")


def _ahead():
    return Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)


def _turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(
        group_key(turns[conversation]).alias("c"), turns[conversation].alias("conv_id"),
        turns[turn].cast("bigint").alias("turn"), turns[role].alias("role"), turns[text].alias("text"))


def _placed(d: DataFrame) -> DataFrame:
    """Turns with their place ``k`` (from 1) among the ``n`` of their conversation, ranked ``range`` by range.

    A range is a run of turn numbers; turns of the null id, which may be any share of all, and turns without
    a number are cut further, by number, role and the upper bits of the hash that orders equal ones.
    """
    d = d.withColumn("digest", F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull())).withColumn(
        "range", F.struct(F.floor(F.col("turn") / TURNS_A_RANGE).alias("numbers"), *[
            F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), x).alias(name)
            for name, x in (("turn", F.col("turn")), ("role", F.col("role")), ("share", F.shiftright("digest", 52)))]))
    parts = d.groupBy("c", "range").agg(F.count("*").alias("m")).select(
        "c", "range", F.coalesce(F.sum("m").over(_ahead()), F.lit(0)).alias("ahead"),
        F.sum("m").over(Window.partitionBy("c")).alias("n"))
    return d.join(parts, ["c", "range"]).withColumn("k", F.col("ahead") + F.row_number().over(_one()))


def prefix_hashes(d: DataFrame) -> DataFrame:
    """Placed turns with ``a`` and ``b``, the hashes of turns 1 to ``k``.

    The hash of a prefix is the sum of hashes of (place, role, text), so it rolls from turn to turn and
    long conversations can be summed range by range.
    """
    placed = _placed(d)
    for name, seed in (("a", 10), ("b", 11)):
        own = F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), F.col("text").isNull(), "role", "text")
        placed = placed.withColumn(f"own_{name}", own.cast("decimal(20,0)"))
    sums = placed.groupBy("c", "range").agg(F.sum("own_a").alias("a"), F.sum("own_b").alias("b")).select(
        "c", "range", *[F.coalesce(F.sum(x).over(_ahead()), F.lit(0)).alias(f"{x}_ahead") for x in ("a", "b")])
    to_here = _one().rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(sums, ["c", "range"]).select(
        "c", "conv_id", "k", "n", *[(F.col(f"{x}_ahead") + F.sum(f"own_{x}").over(to_here)).alias(x) for x in ("a", "b")])


def collapse(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """The maximal conversations: ``c``, ``conv_id``, ``n_turns`` and ``copies``.

    A conversation all of whose turns are the first turns of a longer one is left out; of equal ones the
    smallest id stays, null being the largest, and ``copies`` counts them. Both are joins of hashes:
    equal conversations are one row before the anti-join, and so are equal prefixes.
    """
    hashed = prefix_hashes(_turns(turns, conversation, turn, role, text))
    whole = hashed.where("k = n").groupBy("n", "a", "b").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "c")).alias("first"), F.count("*").alias("copies"))
    begun = hashed.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(begun, ["n", "a", "b"], "left_anti").select(
        F.col("first.c").alias("c"), F.col("first.conv_id").alias("conv_id"), F.col("n").alias("n_turns"), "copies")


def render_maximal(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", turns_a_part: int = TURNS_A_PART) -> DataFrame:
    """Maximal conversations as texts: ``conv_id``, ``part``, ``n_turns``, ``copies``, ``chat``.

    Each turn is ``<|role|>``, a line break, its text and ``<|end|>``; a conversation of more than
    ``turns_a_part`` turns goes on in further parts, so that no task ever holds one of unbounded length.

    Turns come in the order of their numbers (null first), then of role and text; several turns of one
    number are all kept. A null role is rendered as an empty one, a null text too, though neither equals
    an empty one when conversations are compared. Turns of a null id are one conversation. Extra columns
    are not read.
    """
    kept = collapse(turns, conversation, turn, role, text).select("c", "n_turns", "copies")
    placed = _placed(_turns(turns, conversation, turn, role, text).join(kept, "c"))
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return placed.groupBy("c", F.floor((F.col("k") - 1) / turns_a_part).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("k", said.alias("said")))).alias("turns"),
        F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
    ).select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("chat"))
