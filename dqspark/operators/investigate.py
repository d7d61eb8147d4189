"""Investigations: the rows behind a failed test, as a sample and a total.

A sample is the first ``n`` rows by a key the caller names. That is a top-n, so each task keeps
only ``n`` rows and no full sort takes place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.exact import breaks
from dqspark.functions.frames import first_rows
from dqspark.functions.predicates import resolve_columns
from dqspark.functions.values import key_digest, missing, named
from dqspark.operators.scan import fold, frequencies

SAMPLE_ROWS = 100    # rows of a sample when none are asked for
SAMPLE_PARTS = 1024  # parts of a test's failing rows that are ranked side by side

Bounds = Mapping[str, tuple[float | None, float | None]]


def _first(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    return first_rows(df, [named(k) for k in _keys(key)], n)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def any_missing(df: DataFrame, columns: Sequence[str] | str | None = None) -> Column:
    return fold([missing(df, c) for c in resolve_columns(df, columns)], lambda a, b: a | b)


def any_outside(df: DataFrame, bounds: Bounds, inclusive: bool = True) -> Column:
    """Rows that break the effective bounds of at least one column."""
    broken = [
        breaks(df, c, low, high, inclusive)
        for c, (low, high) in bounds.items() if c in df.columns
    ]
    return fold(broken or [F.lit(False)], lambda a, b: a | b)


def investigate_missing(
    df: DataFrame, columns: Sequence[str] | str | None, key: str | Sequence[str], n: int = SAMPLE_ROWS,
) -> DataFrame:
    return _first(df.filter(any_missing(df, columns)), key, n)


def investigate_where(
    df: DataFrame, expr: str, key: str | Sequence[str], n: int = SAMPLE_ROWS,
) -> DataFrame:
    return _first(df.filter(F.expr(expr)), key, n)


def investigate_bounds(
    df: DataFrame, bounds: Bounds, key: str | Sequence[str], n: int = SAMPLE_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    return _first(df.filter(any_outside(df, bounds, inclusive)), key, n)


def samples_of_masks(
    df: DataFrame, masks: Mapping[str, Column], key: Sequence[str], n: int = SAMPLE_ROWS,
) -> DataFrame:
    """The samples of several tests of one dataset in one scan, as (test_id, row).

    Rows are ranked in two steps: among those of a test that share a part of the order's hash, of
    which ``n`` each remain, and then among these. However many rows fail a test, no task ranks them
    all; for small ``n`` Spark cuts each step short in front of its shuffle too.
    """
    failing = F.array_compact(F.array(*[F.when(mask, F.lit(test_id)) for test_id, mask in masks.items()]))
    bad = df.filter(fold(list(masks.values()), lambda a, b: a | b))
    tagged = bad.select(F.struct("*").alias("row"), F.explode(failing).alias("test_id"))
    # The text of a row also orders rows with maps, which have no hash.
    tagged = tagged.withColumn("digest", F.xxhash64(F.to_json("row")))
    order = [*[F.col("row")[k] for k in key], F.col("digest")]
    parts = tagged.withColumn("part", F.pmod("digest", F.lit(SAMPLE_PARTS)))
    for within in (["test_id", "part"], ["test_id"]):
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        parts = parts.withColumn("place", place).filter(F.col("place") <= n).drop("place")
    return parts.select("test_id", "row")


def investigate_duplicates(
    df: DataFrame, columns: str | Sequence[str], key: str | Sequence[str], n: int = SAMPLE_ROWS,
    digest: bool = False,
) -> DataFrame:
    """The first ``n`` rows whose ``columns`` occur more than once.

    Each of these rows belongs to one of the ``n`` repeated keys whose first row comes earliest, so
    those keys are found with one pre-aggregated ``groupBy``, and the second pass over the data looks
    them up. There are ``n`` of them at most, so Spark broadcasts them by its own size check unless
    ``n`` is large, and then splits hot keys at run time.
    ``digest`` groups long texts by their SHA-256.
    """
    columns = _keys(columns)
    exprs = key_digest(df, columns) if digest else [named(c) for c in columns]
    marked = df.select(F.struct("*").alias("row"), *[
        e.alias(f"k{i}") for i, e in enumerate(exprs)
    ])
    order = [F.col("row")[k] for k in _keys(key)]
    # A single key is compared as it is, which hash aggregation can do; several need a struct.
    rank = order[0] if len(order) == 1 else F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    repeated = (
        marked.groupBy(*[f"k{i}" for i in range(len(columns))])
        .agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("earliest"),
             F.max(order[0].isNull()).alias("null_first"))
        .filter(F.col("n") > 1).orderBy(F.col("null_first").desc(), "earliest").limit(n)
        .select(*[F.col(f"k{i}").alias(f"r{i}") for i in range(len(columns))])
    )
    same = fold([F.col(f"k{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(columns))],
                lambda a, b: a & b)
    return _first(marked.join(repeated, same, "left_semi").select("row.*"), key, n)


def investigate_orphans(
    df: DataFrame, key: str | Sequence[str], ref_df: DataFrame, ref_key: str | Sequence[str],
    order: str | Sequence[str] = (), n: int = SAMPLE_ROWS,
) -> DataFrame:
    """The first ``n`` rows whose key is not among the reference keys; a null key is no orphan."""
    keys, ref_keys = _keys(key), _keys(ref_key)
    marked = df.filter(fold([named(k).isNotNull() for k in keys], lambda a, b: a & b)).select(
        F.struct("*").alias("row"), *[named(k).alias(f"k{i}") for i, k in enumerate(keys)])
    known = ref_df.select(*[named(k).alias(f"k{i}") for i, k in enumerate(ref_keys)]).distinct()
    lost = marked.join(known, [f"k{i}" for i in range(len(keys))], "left_anti").select("row.*")
    return _first(lost, order, n)


def duplicate_total(df: DataFrame, columns: str | Sequence[str], digest: bool = False) -> DataFrame:
    """How many rows have a repeated key, as one row."""
    counted = frequencies(df, _keys(columns), digest)
    return counted.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("value"))
