"""Type names: what a filter rule or a metric's declared output may ask of a column."""

from __future__ import annotations

from pyspark.sql import types as T

# The letters a rule may use and the simple types each accepts.
TYPE_CODES = {
    "S": ("string",),
    "I": ("int",),
    "F": ("double",),
    "N": ("int", "double"),
    "T": ("datetime",),
    "D": ("datetime",),
    "B": ("boolean",),
}

# The types a metric may declare for its output columns.
OUTPUT_TYPES = {
    "string": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
}


def simple_type(data_type: T.DataType) -> str:
    """Collapse a Spark type to string / int / double / boolean / datetime.

    Any other type keeps its SQL name, so no code matches it.
    """
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "double"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return data_type.simpleString()


def matches_code(data_type: T.DataType, code: str) -> bool:
    return simple_type(data_type) in TYPE_CODES.get(code.upper(), ())


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)
