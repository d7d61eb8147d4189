"""Numbers compared and added in their own type, where a double would round them."""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.values import field_of, named, number

_LONG = 2**63          # the first number beyond a bigint
_DIGITS = 10**38       # the first number beyond a decimal


class Bound(float):
    """A bound as a double, which keeps in ``exact`` the decimal number that was written."""

    exact: Decimal

    def __new__(cls, value):
        bound = super().__new__(cls, value)
        try:
            bound.exact = getattr(value, "exact", None) or Decimal(str(value))
        except InvalidOperation:
            bound.exact = Decimal(repr(float(bound)))
        return bound


def scale_of(data_type: T.DataType) -> int | None:
    """Decimal places of a type that holds its numbers exactly; None for any other."""
    if isinstance(data_type, T.IntegralType):
        return 0
    return data_type.scale if isinstance(data_type, T.DecimalType) else None


def outside(value: Column, lower: float | None, upper: float | None, inclusive: bool = True) -> Column:
    """True where a number breaks a bound; a null breaks none."""
    broken = F.lit(False)
    if lower is not None:
        broken = broken | ((value < lower) if inclusive else (value <= lower))
    if upper is not None:
        broken = broken | ((value > upper) if inclusive else (value >= upper))
    return F.coalesce(broken, F.lit(False))


def breaks(df: DataFrame, name: str, lower: float | None, upper: float | None, inclusive: bool = True) -> Column:
    """``outside`` for a column, compared in its own type if that is an integer or a decimal.

    A bound becomes the first number of the column's scale that it allows, so no value is converted.
    """
    scale = scale_of(field_of(df, name).dataType)
    if scale is None:
        return outside(number(df, name), *[None if b is None else float(b) for b in (lower, upper)], inclusive)
    column, broken = named(name), F.lit(False)
    for limit, low in ((lower, True), (upper, False)):
        if limit is None:
            continue
        exact = Bound(limit).exact
        if exact.is_infinite():
            beyond = column.isNotNull() if (exact > 0) == low else F.lit(False)
        else:
            scaled = Fraction(exact) * 10**scale
            if low:
                first = math.ceil(scaled) if inclusive else math.floor(scaled) + 1
            else:
                first = math.floor(scaled) if inclusive else math.ceil(scaled) - 1
            beyond = _beyond(column, df, name, scale, first, low)
        broken = broken | beyond
    return F.coalesce(broken, F.lit(False))


def _beyond(column: Column, df: DataFrame, name: str, scale: int, first: int, low: bool) -> Column:
    integral = isinstance(field_of(df, name).dataType, T.IntegralType)
    end = _LONG if integral else _DIGITS
    if not -end < first < end:  # no value of the type is on the other side
        return column.isNotNull() if (first > 0) == low else F.lit(False)
    text = format(Decimal(first).scaleb(-scale), "f") if first else "0"
    limit = F.lit(first) if integral else F.lit(text).cast(f"decimal(38, {scale})")
    own = column.cast("bigint") if integral else column
    return (own < limit) if low else (own > limit)


def summand(df: DataFrame, name: str) -> Column:
    """The value to add up: a decimal of 38 digits for integers and decimals, else a double."""
    scale = scale_of(field_of(df, name).dataType)
    return number(df, name) if scale is None else named(name).cast(f"decimal(38, {scale})")


def comparable(df: DataFrame, name: str) -> Column:
    """The value whose extremes are asked: integers, decimals and moments as they are, else a double."""
    data_type = field_of(df, name).dataType
    if scale_of(data_type) is not None:
        return named(name).cast("bigint") if isinstance(data_type, T.IntegralType) else named(name)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return named(name)
    return number(df, name)
