"""What the operators share: reading, boxed rows, kept tables, ranks within groups of any size."""

from __future__ import annotations

import gc
import math
import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dqspark.sources.readers import work_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: a lost executor costs no recomputation."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Remove kept tables that nothing reads any more; the shuffles they came from go with their plans."""
    for df in kept:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if kept:
        gc.collect()
        jvm.System.gc()  # what no plan refers to any more is cleaned up now, on the driver and on the executors


def boxed(df: DataFrame) -> Column:
    """The whole row as one column ``row``, so that no column of the input clashes with a new one."""
    return F.struct(*[df[c] for c in df.columns]).alias("row")


def unboxed(df: DataFrame, columns: Sequence[str], new: Sequence[str]) -> DataFrame:
    """The input's columns again, then the new ones; a new column replaces one of the same name."""
    taken = {n.lower() for n in new}
    old = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*old, *[F.col(n) for n in new])


def group_key(column: Column) -> Column:
    """A group's name that is never null: nulls are a group of their own, apart from any text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def row_digest(df: DataFrame) -> Column:
    """Orders rows that agree in everything else; rows equal in all columns stay interchangeable."""
    plain = [F.to_json(F.struct(df[c])) if "map<" in t else df[c] for c, t in df.dtypes]
    return F.xxhash64(*plain)


def seeded_order(df: DataFrame, key: str, seed: int) -> Column:
    """A hash that orders rows at random: rows without a key, or with the same one, are spread by all they hold."""
    return F.xxhash64(F.lit(seed), df[key], row_digest(df))


def running(df: DataFrame, ties: Sequence[str], value: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Rank and running sum of ``value`` within the groups ``g``, in the order of the hash ``h``.

    A group may hold any share of the rows: each is cut into as many ranges of the hash as the root of
    the number of rows, ranges are counted first, and a window ranks one range at a time from what the
    ranges before it hold. Gives the rows with ``rank`` (from 1), ``before`` (sum of the values in
    front), ``group_rows`` and ``group_value``; the groups (``g``, ``group_rows``, ``group_value``); and
    the number of rows.
    """
    n = df.count()
    ranges = max(1, math.isqrt(n))
    v = F.col(value) if value else F.lit(0).cast("bigint")
    share = F.shiftrightunsigned("h", 1) / F.lit(float(2**63))
    cut = df.withColumn("range", F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int"))
    parts = cut.groupBy("g", "range").agg(F.count("*").alias("n"), F.sum(v).alias("v"))
    ahead = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    offsets = parts.select(
        "g", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"),
        F.coalesce(F.sum("v").over(ahead), F.lit(0)).alias("v_ahead"),
        F.sum("n").over(whole).alias("group_rows"), F.sum("v").over(whole).alias("group_value"))
    one = Window.partitionBy("g", "range").orderBy("h", *ties)
    ranked = cut.join(offsets, ["g", "range"]).withColumns({
        "rank": F.col("n_ahead") + F.row_number().over(one),
        "before": F.col("v_ahead") + F.sum(v).over(one.rowsBetween(Window.unboundedPreceding, 0)) - v,
    }).drop("range", "n_ahead", "v_ahead")
    groups = parts.groupBy("g").agg(F.sum("n").alias("group_rows"), F.sum("v").alias("group_value"))
    return ranked, groups, n


#: Rows of one range of an order, and the largest number of ranges.
ROWS_A_RANGE, RANGES = 50_000, 20_000


def placed(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows, kept, in ranges ``part`` of (``group``, ``order``), and the ranges of each group.

    The second frame has a row for each ``part`` and group: ``n`` rows there, ``ahead`` rows of the
    group in the ranges before it. A group of any size is cut where the order allows; only rows that
    agree in all of it share a range. ``df`` is read twice and should be a kept table.
    """
    ranges = min(RANGES, -(-max(df.count(), 1) // ROWS_A_RANGE))
    cut = df.repartitionByRange(ranges, *[F.col(g) for g in group], *order).withColumn("part", F.spark_partition_id())
    kept = keep(cut, "ordered")
    counts = kept.groupBy("part", *group).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return kept, counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their number (from 1) within their group (never null), in the given order."""
    kept, ranges = placed(df, group, order)
    own = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order))
    return kept.join(ranges.drop("n"), ["part", *group]).withColumn(name, F.col("ahead") + own).drop("part", "ahead")
