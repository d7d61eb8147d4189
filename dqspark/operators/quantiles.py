"""Exact values at ranks of columns, by ranges that close in on them; no sort of the table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.exact import comparable, scale_of
from dqspark.functions.frames import local_frame
from dqspark.functions.predicates import QUANTILE, SKETCH_SIZE
from dqspark.functions.types import is_numeric
from dqspark.functions.values import field_of, how_many, number

GRID = 1000           # steps of the ranks that a sketch is asked for
MARGIN = Fraction(1, 200)  # ranks on either side of the one looked for that a range takes in: twice the sketch's error
GATHERED = 10_000     # values of a range that are fetched and counted off, less than a sketch weighs


def quantile_kind(df: DataFrame, name: str) -> str:
    return "bigint" if isinstance(field_of(df, name).dataType, T.IntegralType) else "double"


@dataclass
class _Search:
    """The row of rank ``k`` (from 1) among the ``n`` values of a column, known to be in a range."""
    column: str
    k: int
    low: Any = None            # the range that holds it, open at an end that is excluded
    high: Any = None
    low_open: bool = False
    high_open: bool = False
    below: int = 0             # values in front of the range
    inside: int = 0            # values in it
    answer: Any = None
    tried: tuple | None = None  # the range whose counts the next scan gives

    def inside_of(self, value: Column, limits: tuple) -> Column:
        low, low_open, high, high_open, lit = *limits, self.lit
        return ((value > lit(low)) if low_open else (value >= lit(low))) & ((value < lit(high)) if high_open else (value <= lit(high)))

    def lit(self, x):  # replaced for decimals
        return F.lit(x)


def _narrower(s: _Search, grid: Sequence[Any]) -> tuple:
    """The next range to try: around the rank in the sketch of the present one, or one value if that is no narrower."""
    rank = Fraction(s.k - s.below, s.inside)
    first = grid[max(0, math.floor((rank - MARGIN) * GRID))]
    last = grid[min(GRID, math.ceil((rank + MARGIN) * GRID))]
    if (first, last) == (s.low, s.high):
        middle = grid[min(GRID, math.floor(rank * GRID))]
        return middle, False, middle, False
    return first, s.low_open and first == s.low, last, s.high_open and last == s.high


def _settle(s: _Search, below: int, upto: int) -> None:
    """Take the tried range, whose counts are known, or the part of the present one that it leaves."""
    low, low_open, high, high_open = s.tried
    if below < s.k <= upto:
        s.low, s.low_open, s.high, s.high_open = s.tried
        s.below, s.inside = below, upto - below
    elif s.k <= below:
        s.high, s.high_open, s.inside = low, not low_open, below - s.below
    else:
        s.low, s.low_open, s.inside, s.below = high, not high_open, s.below + s.inside - upto, upto
    s.tried = None
    if s.low == s.high:
        s.answer = s.low


def exact_quantiles(df: DataFrame, columns: Sequence[str] | None = None, quantiles: Sequence[float] = (0.5,),
                    interpolate: bool = False) -> DataFrame:
    """The value at each share of the order of each numeric column: (column, quantile, value, exact, n).

    The smallest value with at least that share of the values up to it; with ``interpolate`` the point between
    the two neighbours of the place, as a double. Nulls, NaN and text that is no number are left out; without
    values ``value`` is null. ``exact`` is the text of integers and decimals.

    One scan sketches all columns. Every further scan counts the values in front of and within a range around
    each rank, and sketches that range, until it holds one value or few enough to be fetched. A range shrinks
    to about a hundredth with each scan, so a table of any size takes a handful, and the driver sees some
    thousand numbers a column. A range that its counts refute is replaced by what it left out, so the answer
    never rests on the sketches.
    """
    names = list(columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    kinds = {c: quantile_kind(df, c) for c in names}
    values = {c: number(df, c) if scale_of(field_of(df, c).dataType) is None else comparable(df, c) for c in names}
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def grid_of(c: str, condition: Column | None = None) -> Column:
        own = values[c] if condition is None else F.when(condition, values[c])
        sketch, quantile, n = QUANTILE[kinds[c]]
        made = sketch(own.cast(kinds[c]), F.lit(SKETCH_SIZE))
        return F.when(n(made) > 0, quantile(made, ranks))

    first = df.agg(*[x for i, c in enumerate(names) for x in (F.count(values[c]).alias(f"n{i}"), grid_of(c).alias(f"g{i}"))]).first() if names else None
    sizes = {c: first[f"n{i}"] for i, c in enumerate(names)}
    searches: dict[tuple[str, int], _Search] = {}
    grids = {}
    for i, c in enumerate(names):
        for q in quantiles if sizes[c] else ():
            for k in _ranks(q, sizes[c], interpolate)[0]:
                s = _Search(c, k, first[f"g{i}"][0], first[f"g{i}"][-1], inside=sizes[c])
                scale = scale_of(field_of(df, c).dataType)
                if scale and kinds[c] == "double":
                    # a sketch of doubles only says where to look: its ends are widened by one place
                    step = Decimal(1).scaleb(-scale)
                    s.low, s.high = Decimal(repr(s.low)) - max(step, abs(Decimal(repr(s.low))) / 10**15), Decimal(repr(s.high)) + max(step, abs(Decimal(repr(s.high))) / 10**15)
                    s.lit = lambda x, scale=scale: F.lit(format(Decimal(x), "f")).try_cast(f"decimal(38, {min(37, scale + 2)})")
                searches[c, k] = s
                grids[c, k] = [Decimal(repr(x)) for x in first[f"g{i}"]] if scale and kinds[c] == "double" else first[f"g{i}"]
                if s.low == s.high:
                    s.answer = s.low
    while open_ := [(key, s) for key, s in searches.items() if s.answer is None]:
        asked = []
        for i, (key, s) in enumerate(open_):
            value = values[s.column]
            if s.inside <= GATHERED:
                inside = s.inside_of(value, (s.low, s.low_open, s.high, s.high_open))
                asked.append(F.sort_array(F.collect_list(F.when(inside, value))).alias(f"v{i}"))
                continue
            s.tried = _narrower(s, grids[key]) if key in grids else (s.low, s.low_open, s.high, s.high_open)
            low, low_open, high, high_open = s.tried
            asked += [how_many((value <= s.lit(low)) if low_open else (value < s.lit(low))).alias(f"b{i}"),
                      how_many((value < s.lit(high)) if high_open else (value <= s.lit(high))).alias(f"u{i}")]
            if s.inside * 2 * MARGIN > GATHERED / 2 or key not in grids:  # else the next scan fetches the range
                asked.append(grid_of(s.column, s.inside_of(value, s.tried)).alias(f"g{i}"))
        found = df.agg(*asked).first()
        for i, (key, s) in enumerate(open_):
            if s.tried is None:
                s.answer = found[f"v{i}"][s.k - s.below - 1]
                continue
            tried = s.tried
            _settle(s, found[f"b{i}"], found[f"u{i}"])
            grids.pop(key, None)
            grid = found[f"g{i}"] if f"g{i}" in found else None
            if (s.low, s.low_open, s.high, s.high_open) == tried and grid:
                grids[key] = [Decimal(repr(x)) for x in grid] if isinstance(s.low, Decimal) else grid
    rows = []
    for c in names:
        exact = scale_of(field_of(df, c).dataType) is not None
        for q in quantiles:
            if not sizes[c]:
                rows.append((c, float(q), None, None, 0))
                continue
            ks, part = _ranks(q, sizes[c], interpolate)
            ends = [searches[c, k].answer for k in ks]
            value = float(ends[0]) if part == 0 or ends[0] == ends[-1] else float(ends[0]) + (float(ends[-1]) - float(ends[0])) * float(part)
            same = exact and (part == 0 or ends[0] == ends[-1])
            rows.append((c, float(q), value, _text(ends[0], field_of(df, c).dataType) if same else None, sizes[c]))
    return local_frame(df.sparkSession, rows, "column string, quantile double, value double, exact string, n bigint")


def _ranks(q: float, n: int, interpolate: bool) -> tuple[list[int], Fraction]:
    """The ranks whose values give a quantile, and how far it is from the first towards the second."""
    share = Fraction(str(q))
    if not interpolate:
        return [max(1, math.ceil(share * n))], Fraction(0)
    place = share * (n - 1)
    return list(dict.fromkeys((math.floor(place) + 1, math.ceil(place) + 1))), place - math.floor(place)


def _text(value: Any, data_type: T.DataType) -> str:
    scale = scale_of(data_type)
    return str(value) if not scale else format(Decimal(value).quantize(Decimal(1).scaleb(-scale)), "f")
