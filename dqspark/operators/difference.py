"""What changed from one delivery to the next: rows added, removed and changed, copies counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.values import field_of, named
from dqspark.operators.skew import salted_join


def _cell(df: DataFrame, name: str) -> Column:
    """A cell as text; two are the same if and only if the values are."""
    kind = field_of(df, name).dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(named(name))
    return F.to_json(F.struct(named(name))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else named(name).cast("string")


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A SHA-256 of some cells, each with its length, so that no two rows read the same; nulls are equal."""
    cells = [_cell(df, c) for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]), 256))


def difference(before: DataFrame, after: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows that are not the same in both: (``kind``, ``n``, ``before``, ``after``, ``changed``).

    Rows are compared as a multiset: three copies that were two are one copy ``added``. ``n`` counts copies.
    A key with one row too many on either side, and no more, is a ``changed`` row with both its forms and the
    names of the columns that differ; other rows are ``added`` or ``removed``. Nulls are equal to each other, a key
    with a null names no row. Columns of only one side are not compared.

    Only a digest of each row and its key is shuffled, counted in part before; whole rows are fetched for
    the differences alone. Copies of one row, however many, are one row by then; a key with many different rows
    is split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [c for c in before.columns if c in after.columns]
    lacking = [k for k in keys if k not in columns]
    if lacking:
        raise KeyError(f"key columns {lacking} are not on both sides")
    for c in columns:
        if field_of(before, c).dataType != field_of(after, c).dataType:
            after = after.withColumn(c, named(c).cast(field_of(before, c).dataType))

    def digests(df: DataFrame, sign: int) -> DataFrame:
        whole = F.lit(True)
        for k in keys:
            whole = whole & named(k).isNotNull()
        return df.select(row_key(df, columns).alias("row"), F.when(whole, row_key(df, keys)).alias("key"), F.lit(sign).alias("sign"))

    net = digests(before, -1).unionByName(digests(after, 1)).groupBy("row", "key").agg(F.sum("sign").alias("net")).where("net <> 0")
    single = net.groupBy("key").agg(
        F.sum(F.when(F.col("net") < 0, -F.col("net"))).alias("gone"), F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("come"))
    single = single.where("key is not null and gone = 1 and come = 1").select("key", F.lit(True).alias("paired"))
    marked = salted_join(net, single, ["key"], "left", ["row"]).select("row", "key", "net", F.coalesce("paired", F.lit(False)).alias("paired"))

    def rows(df: DataFrame, sign: int) -> DataFrame:
        wanted = marked.where(F.col("net") * sign > 0).withColumn("n", F.abs("net")).drop("net")
        cells = df.select(row_key(df, columns).alias("row"), F.struct(*[named(c) for c in columns]).alias("cells"))
        return cells.join(wanted.select("row"), "row", "left_semi").dropDuplicates(["row"]).join(wanted, "row")

    old, new = rows(before, -1), rows(after, 1)
    nothing = F.lit(None).cast(old.schema["cells"].dataType)
    none = F.lit(None).cast("array<string>")
    pairs = old.where("paired").select("key", F.col("cells").alias("before")).join(
        new.where("paired").select("key", F.col("cells").alias("after")), "key")
    changed = F.array_compact(F.array(*[
        F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in columns if not isinstance(field_of(before, c).dataType, T.MapType)]))
    one = F.lit(1).cast("bigint")
    return old.where("not paired").select(F.lit("removed").alias("kind"), "n", F.col("cells").alias("before"), nothing.alias("after"), none.alias("changed")).union(
        new.where("not paired").select(F.lit("added"), "n", nothing, F.col("cells"), none)).union(
        pairs.select(F.lit("changed"), one, "before", "after", changed))
