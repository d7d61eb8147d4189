"""Checks that need an order within a key, where one key may hold all rows.

Rows are sorted once, into ranges of (key, order); what a range needs to know of the rows of its first
key in front of it is carried over its edge. Only the key that lies across an edge needs that, so there
are at most as many carried sets as ranges, and no task sees more than its range. Ties are settled by a
hash of the row, which also cuts a key whose rows all agree in the order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from dqspark.functions.exact import summand
from dqspark.functions.values import field_of, named
from dqspark.sources.work import kept

#: Rows of a range, and the largest number of ranges.
ROWS_A_RANGE, RANGES = 100_000, 20_000

#: Columns of the sorted rows beside those of the input.
PART, TIE, CARRIED = "__part", "__tie", "__carried"


def _names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.to_json(F.struct(named(c))) if "map<" in t else named(c) for c, t in df.dtypes])


def _free(df: DataFrame, names: Sequence[str]) -> None:
    held = {c.lower() for c in df.columns}
    clash = [n for n in names if n.lower() in held]
    if clash:
        raise ValueError(f"the input already has columns {clash}")


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, kept, with the number of their range of (``group``, ``order``) and a hash for ties."""
    _free(df, [PART, TIE, CARRIED])
    for c in [*group, *order]:
        field_of(df, c)
    hashed = df.withColumn(TIE, _hash(df))
    ranges = min(RANGES, -(-max(df.count(), 1) // ROWS_A_RANGE))
    cut = hashed.repartitionByRange(ranges, *[named(c) for c in [*group, *order]], F.col(TIE))
    return kept(cut.withColumn(PART, F.spark_partition_id()), "ranges")


def _inside(group: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(PART, *[named(g) for g in group]).orderBy(*[named(c) for c in order], F.col(TIE))


def _at_edges(rows: DataFrame, edges: DataFrame, group: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined with what ``edges`` say of the same range and key, nulls being equal; columns of ``rows`` first."""
    theirs = {PART: "__p", **{g: f"__k{i}" for i, g in enumerate(group)}}
    named_apart = edges.select(*[named(c).alias(theirs.get(c, c)) for c in edges.columns])
    same = F.col(PART) == F.col("__p")
    for g in group:
        same = same & named(g).eqNullSafe(F.col(theirs[g]))
    return rows.join(named_apart, same, how).drop(*theirs.values())


def carried(cut: DataFrame, group: Sequence[str], totals: Mapping[str, Column], over: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """The sorted rows beside what their key holds in earlier ranges.

    ``totals`` are aggregates of one key in one range, ``over`` tells how those of earlier ranges are put
    together. They are null in a key's first range.
    """
    keys = [named(g) for g in group]
    parts = cut.groupBy(PART, *keys).agg(*[c.alias(n) for n, c in totals.items()])
    ahead = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    edges = parts.select(PART, *keys, spans.alias("__spans"), *[f(F.col(n)).over(ahead).alias(n) for n, f in over.items()])
    return _at_edges(cut, edges.where("__spans > 1").drop("__spans"), group, "left")


def trailing(
    df: DataFrame, group: Sequence[str] | str, order: Sequence[str] | str, n: int, build: Callable[[WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """The rows with new columns that look back at most ``n`` rows of the same group.

    ``build`` is handed a window, ordered and partitioned, and gives the columns: ``F.lag(c, k).over(w)`` with
    ``k`` up to ``n``, aggregates over ``w.rowsBetween(-k, ...)``. Groups of nulls are groups; nulls
    of the order come first. The last ``n`` rows of a key at an edge (under twice as many where ranges are
    short) are read by both sides of it.
    """
    if n < 1:
        raise ValueError(f"a frame looks back one row or more, not {n}")
    group, order = _names(group), _names(order)
    cut = in_ranges(df, group, order)
    keys = [named(g) for g in group]
    parts = cut.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("__rows"))
    every, sofar = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(PART)
    parts = parts.withColumns({"__spans": F.count(F.lit(1)).over(every), "__end": F.sum("__rows").over(sofar)}).where("__spans > 1")
    tails = _at_edges(cut, parts.select(PART, *keys), group, "left_semi")
    back = Window.partitionBy(PART, *keys).orderBy(*[named(c).desc() for c in order], F.col(TIE).desc())
    tails = tails.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n)
    columns = [*df.columns, TIE]
    tails = tails.groupBy(PART, *keys).agg(F.collect_list(F.struct(*[named(c) for c in columns])).alias("__tail"))
    ends = _at_edges(parts, tails, group, "inner")
    reach = Window.partitionBy(*keys).orderBy("__end").rangeBetween(-(n - 1), 0)
    edges = ends.withColumn("__tail", F.flatten(F.collect_list("__tail").over(reach)))
    edges = edges.withColumn("__tail", F.lag("__tail").over(sofar)).select(PART, F.explode("__tail").alias("__row"))
    before = edges.select(PART, *[F.col("__row").getField(c).alias(c) for c in columns], F.lit(True).alias(CARRIED))
    rows = cut.withColumn(CARRIED, F.lit(False)).unionByName(before)
    new = dict(build(_inside(group, order)))
    _free(df, list(new))
    return rows.withColumns(new).where(f"not {CARRIED}").drop(PART, TIE, CARRIED)


def balances(df: DataFrame, group: Sequence[str] | str, order: Sequence[str] | str, value: str, name: str = "balance") -> DataFrame:
    """The rows with the running sum of ``value`` in their group, themselves included; nulls add nothing.

    Integers and decimals are added as decimals of 38 digits.
    """
    group, order = _names(group), _names(order)
    _free(df, [name])
    cut = in_ranges(df, group, order)
    rows = carried(cut, group, {"__ahead": F.sum(summand(df, value))}, {"__ahead": F.sum})
    own = F.sum(summand(df, value)).over(_inside(group, order).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0)
    total = F.coalesce(F.col("__ahead"), zero) + F.coalesce(own, zero)
    return rows.withColumn(name, total).drop("__ahead", PART, TIE)


def as_of(
    df: DataFrame, versions: DataFrame, key: Sequence[str] | str, at: str, since: str, version_key: Sequence[str] | str | None = None,
    name: str = "version",
) -> DataFrame:
    """The rows, each with the version of its key that was the latest at its time, as a struct; null where there is none.

    A version holds from ``since`` on, at that very time too. Of versions that begin together the one with the largest hash
    counts. A row without time or with a null in its key has no version; versions without either are no one's.
    Rows and versions are sorted together: nothing is joined by key, so a key may hold all rows.
    """
    keys, theirs = _names(key), _names(version_key or key)
    if len(keys) != len(theirs):
        raise ValueError(f"keys {keys} and {theirs} differ in number")
    _free(df, [name])
    ks = [f"k{i}" for i in range(len(keys))]

    def full(columns: Sequence[str]) -> Column:
        found = F.lit(True)
        for c in columns:
            found = found & named(c).isNotNull()
        return found

    for frame, names in ((df, [*keys, at]), (versions, [*theirs, since])):
        for c in names:
            field_of(frame, c)
    usable = full([*keys, at])
    row, version = F.struct(*[named(c) for c in df.columns]), F.struct(*[named(c) for c in versions.columns])
    facts = df.where(usable).select(*[named(c).alias(k) for c, k in zip(keys, ks)], named(at).alias("t"), F.lit(1).alias("kind"), row.alias("row"))
    known = versions.where(full([*theirs, since])).select(
        *[named(c).alias(k) for c, k in zip(theirs, ks)], named(since).alias("t"), F.lit(0).alias("kind"), version.alias("v"))
    cut = in_ranges(facts.unionByName(known, allowMissingColumns=True), ks, ["t", "kind"])
    place = F.when(F.col("kind") == 0, F.struct("t", TIE))
    latest = F.max_by(F.struct("v"), place)
    rows = carried(cut, ks, {"__last": latest}, {"__last": lambda c: F.last(c, ignorenulls=True)})
    own = F.last("v", ignorenulls=True).over(_inside(ks, ["t", "kind"]).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn(name, F.coalesce(own, F.col("__last.v"))).where("kind = 1")
    resolved = found.select(*[F.col("row").getField(c).alias(c) for c in df.columns], named(name))
    nothing = F.lit(None).cast(found.schema[name].dataType)
    return resolved.union(df.where(~usable).select(*[named(c) for c in df.columns], nothing.alias(name)))


# Sides of time: since ever, a point in time, for ever.
_EVER, _POINT, _OPEN = 0, 1, 2


def _periods(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct valid periods and their copies: one with the same bounds a million times is one row from here on."""
    _free(df, ["n_rows"])
    valid = named(start).isNull() | named(end).isNull() | (named(end) > named(start))
    return df.where(valid).groupBy(*[named(c) for c in [*key, start, end]]).agg(F.count(F.lit(1)).alias("n_rows"))


def overlaps(df: DataFrame, key: Sequence[str] | str, start: str, end: str) -> DataFrame:
    """How many other rows of its key each period overlaps: (key, ``start``, ``end``, ``n_rows``, ``n_overlaps``), one row for equal ones.

    Periods include their start and not their end; a null start is since ever, a null end is open. Those that end no later
    than they start overlap nothing and are left out. ``n_overlaps`` is exact and counts the ``n_rows - 1`` equal rows too:
    what has begun before a period ends, less what had ended when it began. So no pair is ever made, and the work is that
    of one sort, however much overlaps.
    """
    key = _names(key)
    periods = _periods(df, key, start, end)
    begin = F.struct(F.when(named(start).isNull(), _EVER).otherwise(_POINT).alias("side"), named(start).alias("t"), F.lit(1).alias("kind"))
    finish = F.struct(F.when(named(end).isNull(), _OPEN).otherwise(_POINT).alias("side"), named(end).alias("t"), F.lit(0).alias("kind"))
    marks = periods.withColumn("__at", F.explode(F.array(begin, finish)))
    cut = in_ranges(marks, key, ["__at"])
    began, ended = (F.when(F.col("__at.kind") == k, F.col("n_rows")).otherwise(0) for k in (1, 0))
    rows = carried(cut, key, {"__began": F.sum(began), "__ended": F.sum(ended)}, {"__began": F.sum, "__ended": F.sum})
    own = _inside(key, ["__at"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "__began": F.coalesce("__began", F.lit(0)) + F.sum(began).over(own), "__ended": F.coalesce("__ended", F.lit(0)) + F.sum(ended).over(own)})
    met = F.sum(F.when(F.col("__at.kind") == 0, F.col("__began")).otherwise(-F.col("__ended"))) - 1
    return rows.groupBy(*[named(c) for c in [*key, start, end]]).agg(F.max("n_rows").alias("n_rows"), met.alias("n_overlaps"))


def merged_periods(df: DataFrame, key: Sequence[str] | str, start: str, end: str, touching: bool = True) -> DataFrame:
    """Each key's periods put together where they overlap (or touch): (key, ``start``, ``end``, ``n_rows``).

    Bounds as in ``overlaps``. Sorted by start, a period opens a new stretch if all before it have ended; the latest end
    and the number of stretches are carried over the edges of ranges.
    """
    key = _names(key)
    side = F.when(named(end).isNull(), _OPEN).otherwise(_POINT).alias("side")
    reach = F.struct(side, named(end).alias("t"))
    cut = in_ranges(_periods(df, key, start, end).withColumn("__end", reach), key, [start, end])
    rows = carried(cut, key, {"__latest": F.max("__end")}, {"__latest": F.max})
    inside = _inside(key, [start, end])
    before = F.greatest(F.col("__latest"), F.max("__end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    apart = named(start) > F.col("__before.t") if touching else named(start) >= F.col("__before.t")
    opens = F.col("__before").isNull() | (F.col("__before.side") == _POINT) & F.coalesce(apart, F.lit(False))
    rows = rows.withColumn("__before", before).withColumn("__opens", F.when(opens, 1).otherwise(0))
    rows = rows.withColumn("__nth", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [named(k) for k in key]
    pieces = kept(rows.groupBy(PART, *keys, "__nth").agg(
        F.min(F.struct(named(start).alias("t"))).alias("__first"), F.max("__end").alias("__last"), F.sum("n_rows").alias("n_rows")), "stretches")
    numbered = carried(pieces, key, {"__ahead": F.max("__nth")}, {"__ahead": F.sum})
    stretch = F.coalesce("__ahead", F.lit(0)) + F.col("__nth")
    whole = numbered.groupBy(*keys, stretch.alias("__stretch")).agg(
        F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("n_rows").alias("n_rows"))
    return whole.select(*keys, F.col("__first.t").alias(start), F.col("__last.t").alias(end), "n_rows")
