"""The most frequent values of a column, exactly, without grouping all of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.frames import first_rows
from dqspark.functions.values import absent, named
from dqspark.operators.scan import frequencies

TRACKED = 1_000         # values a summary tracks at first; a summary of more is tried if that proves nothing
MOST_TRACKED = 100_000


def summary(df: DataFrame, column: str, tracked: int = TRACKED) -> Column:
    """An aggregate: a summary of the frequent values of a column, which ``merged_summaries`` adds up."""
    quoted = "`" + column.replace("`", "``") + "`"
    floating = dict(df.dtypes)[column] in ("float", "double")
    value = f"case when not isnan({quoted}) then {quoted} end" if floating else quoted
    return F.expr(f"approx_top_k_accumulate({value}, {int(tracked)})")


def merged_summaries(summaries: DataFrame, column: str) -> DataFrame:
    """One summary, in the column of the same name, of all rows of stored ones."""
    return summaries.agg(F.expr(f"approx_top_k_combine(`{column}`)").alias(column))


def candidates(summaries: DataFrame, column: str, k: int) -> DataFrame:
    """The likely most frequent values of summaries, with counts that may be too high: (value, about)."""
    listed = F.inline(F.expr(f"approx_top_k_estimate(`{column}`, {int(k)})"))
    return summaries.select(listed).toDF("value", "about")


def _unseen(rows: int, tracked: int) -> float:
    """How often a value that a summary does not list can stand at most: its table has a power of two places."""
    places = 1 << max(3, (int(tracked / 0.75) - 1).bit_length())
    return rows * 3.5 / places


def frequent_values(df: DataFrame, column: str, k: int = 20, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of a column with their counts: (value, n, share); ties by value.

    Nulls and NaN are left out; ``share`` is of the values. A mergeable summary lists candidates in one scan; a
    second one counts them. The result is exact: the k-th count is above what an unlisted value can have.
    Where it is not, a larger summary is made; a column without frequent values is grouped in the end.
    """
    known = df.where(~absent(df, column))
    while tracked <= MOST_TRACKED:
        made = df.agg(F.count(F.when(~absent(df, column), 1)).alias("n"), summary(df, column, tracked).alias("s")).selectExpr(
            "n", f"transform(approx_top_k_estimate(s, {int(tracked)}), x -> x.item) as items").first()
        counted = _counts(known, column, made.items, made.n)
        top = [r.n for r in first_rows(counted.select("n"), [F.desc("n")], k).collect()]
        # proven: no unlisted value stands as often, or the listed ones are all there are
        if (len(top) == k and top[-1] > _unseen(made.n, tracked)) or counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == made.n:
            return first_rows(counted, [F.desc("n"), F.asc("value")], k)
        tracked *= 10
    rows = known.count()
    whole = frequencies(known, [column]).select(named(column).alias("value"), "n", (F.col("n") / F.lit(max(rows, 1))).alias("share"))
    return first_rows(whole, [F.desc("n"), F.asc("value")], k)


def _counts(known: DataFrame, column: str, items: Iterable, rows: int) -> DataFrame:
    """Exact counts of the candidates, which are at most as many as a summary tracks."""
    kind = known.schema[column].dataType
    listed = known.sparkSession.createDataFrame([(x,) for x in items], f"value {kind.simpleString()}")
    hits = known.select(named(column).alias("value")).join(F.broadcast(listed), "value", "left_semi")
    return hits.groupBy("value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(max(rows, 1)))
