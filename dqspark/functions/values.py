"""Column expressions that settle, once, what is missing and what is a number.

All are built-in functions, so every operator made of them stays in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.types import simple_type

# Text that Java parses as a number although no data file means it as one:
# a type suffix ("12d", "1.f") or a hexadecimal float. "inf" is left alone.
_JAVA_ONLY_NUMBER = r"[0-9.][dDfF]\s*$|[xX]"


def named(name: str) -> Column:
    """The column of exactly this name, even if it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise KeyError(f"column '{name}' not found; columns are {df.columns}")


def absent(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a float column."""
    data_type = field_of(df, name).dataType
    column = named(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def missing(df: DataFrame, name: str) -> Column:
    """Absent, or text that is empty once spaces are trimmed."""
    if simple_type(field_of(df, name).dataType) == "string":
        return named(name).isNull() | (F.trim(named(name)) == F.lit(""))
    return absent(df, name)


def number(df: DataFrame, name: str) -> Column:
    """The value as a double; null when it is no number. Never raises under ANSI."""
    data_type = field_of(df, name).dataType
    column = named(name)
    kind = simple_type(data_type)
    if kind == "string":
        parsed = F.when(~column.rlike(_JAVA_ONLY_NUMBER), column.try_cast("double"))
        return F.when(~F.isnan(parsed), parsed)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if kind in ("int", "double", "boolean"):
        return column.cast("double")
    return F.lit(None).cast("double")


def how_many(condition: Column) -> Column:
    """Rows where a condition is true, as the plain aggregate Catalyst plans fastest."""
    return F.count(F.when(condition, 1))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def number_text(value: str) -> str:
    """SQL for a double as people write it: no exponent between 1e-4 and 1e16."""
    plain = f"regexp_replace(cast(try_cast({value} as decimal(38, 20)) as string), '0+$', '')"
    return (
        f"case when abs({value}) >= 1e7 and abs({value}) < 1e16 or abs({value}) >= 1e-4 and abs({value}) < 1e-3 "
        f"then if({plain} like '%.', concat({plain}, '0'), {plain}) else cast({value} as string) end")


def key_digest(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Grouping columns for wide text keys: a SHA-256 in place of each long text.

    Shuffling 32 bytes instead of whole documents; columns of other types stay as they are.
    """
    return [
        F.unhex(F.sha2(named(n), 256)).alias(n)
        if simple_type(field_of(df, n).dataType) == "string"
        else named(n)
        for n in names
    ]


def quarter_label(moment: Column) -> Column:
    """'Q4 2025' for a date or timestamp in the last quarter of 2025."""
    return F.concat(
        F.lit("Q"), F.quarter(moment).cast("string"), F.lit(" "), F.year(moment).cast("string")
    )
