"""Small frames: rows the driver already holds, and the first rows of large ones."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T

_ARROW = {
    T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(),
    T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(),
}


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """Rows as a local relation: no task reads it, and joins know how small it is."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    table = pa.table({
        f.name: pa.array(values, type=_ARROW[type(f.dataType)])
        for f, values in zip(schema.fields, columns)
    })
    return spark.createDataFrame(table, schema)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, or any ``n`` without one.

    Spark plans both with a limit in each task in front of the exchange; the scan keeps its tasks.
    """
    return (df.orderBy(*order) if order else df).limit(n)
