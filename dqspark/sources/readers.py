"""Datasets: files, tables, queries and in-memory frames as DataFrames."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dqspark.functions.frames import first_rows, local_frame
from dqspark.functions.predicates import resolve_columns
from dqspark.functions.values import how_many, named
from dqspark.sources.arrays import read_array
from dqspark.sources.work import work_folder  # noqa: F401

_SUFFIXES = {
    ".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl",
}


def load(
    spark: SparkSession,
    src: str | None = None,
    fmt: str | None = None,
    *,
    table: str | None = None,
    query: str | None = None,
    frame: Any = None,
    schema: T.StructType | str | None = None,
    options: dict[str, Any] | None = None,
    null_tokens: Sequence[str] = (),
    fallback_csv: bool = True,
) -> DataFrame:
    """One dataset from a path, a metastore table, a SQL query or a small local frame.

    ``fmt`` is parquet, csv, tsv, json (one array of records per file, read whole by one task), json_array (the
    same, read by many tasks; it needs a ``schema``) or jsonl (one record per line, which Spark can split); without it the path's suffix decides, and a name without a known
    suffix is a table. Inferring a text file's types reads it once more: give ``schema`` for big
    ones. ``null_tokens`` are texts such as NA that stand for a missing value.
    """
    if frame is not None:
        return frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame, schema)
    if query is not None:
        return spark.sql(query)
    if table is not None:
        return spark.table(table)
    if src is None:
        raise ValueError("a dataset needs a path, a table, a query or a frame")
    fmt = fmt or _SUFFIXES.get(posixpath.splitext(src.rstrip("/"))[1].lower())
    if fmt is None:
        return spark.table(src)
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        try:
            df = reader.parquet(src)
            df.schema
            return df
        except Exception:
            # Only text under a Parquet name is read as CSV; any other failure stays one.
            if not fallback_csv or not _has_text(spark, src):
                raise
            fmt = "csv"
    if fmt in ("csv", "tsv"):
        return _read_text(spark, src, fmt, schema, options or {}, null_tokens)
    if fmt in ("json", "jsonl"):
        reader = spark.read.options(**(options or {})).option("multiLine", fmt == "json")
        return (reader.schema(schema) if schema is not None else reader).json(src)
    if fmt == "json_array":
        if schema is None:
            raise ValueError("an array that many tasks read needs a schema")
        return read_array(spark, src, schema, options)
    raise ValueError(f"unknown format '{fmt}'")


def _has_text(spark: SparkSession, src: str) -> bool:
    """Whether the path exists and does not start like a Parquet file."""
    try:
        first = spark.read.text(src).limit(1).collect()
    except PySparkException:
        return False
    return bool(first) and not first[0][0].startswith("PAR1")


def _read_text(spark, src, fmt, schema, options, null_tokens) -> DataFrame:
    options = {"header": True, **options}
    if fmt == "tsv":
        options["sep"] = "\t"
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not null_tokens:
        if wanted is None:
            return spark.read.options(inferSchema=True, **options).csv(src)
        if str(options["header"]).lower() != "true":
            return spark.read.options(**options).schema(wanted).csv(src)
        return _read_by_name(spark, src, options, wanted)
    raw = spark.read.options(inferSchema=False, **options).csv(src)
    raw = raw.select(*[
        F.when(~F.trim(named(c)).isin(list(null_tokens)), named(c)).alias(c) for c in raw.columns
    ])
    if wanted is None:
        return _infer_types(raw)
    _refuse_absent([f.name for f in wanted.fields], raw.columns)
    return raw.select(*[named(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def _read_by_name(spark, src, options, wanted: T.StructType) -> DataFrame:
    """Columns found by the header's names, whatever their order; a file with another header is an error."""
    header = spark.read.options(inferSchema=False, **options).csv(src).columns
    _refuse_absent([f.name for f in wanted.fields], header)
    kinds = {f.name.lower(): f.dataType for f in wanted.fields}
    given = T.StructType([T.StructField(c, kinds.get(c.lower(), T.StringType())) for c in header])
    raw = spark.read.options(**{"enforceSchema": False, **options}).schema(given).csv(src)
    return raw.select(*[named(f.name).alias(f.name) for f in wanted.fields])


def _refuse_absent(expected: Sequence[str], present: Sequence[str]) -> None:
    there = {c.lower() for c in present}
    absent = [c for c in expected if c.lower() not in there]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")


def file_columns(
    spark: SparkSession, src: str, fmt: str | None = None, options: dict[str, Any] | None = None,
) -> list[str]:
    """The columns a file itself has: a text file's header, without reading on, or the schema of others."""
    fmt = fmt or _SUFFIXES.get(posixpath.splitext(src.rstrip("/"))[1].lower())
    if fmt in ("csv", "tsv"):
        given = {"header": True, **({"sep": "\t"} if fmt == "tsv" else {}), **(options or {})}
        return spark.read.options(inferSchema=False, **given).csv(src).columns
    return load(spark, src, fmt, options=options).columns


def _infer_types(raw: DataFrame) -> DataFrame:
    """The first of Spark's own candidates that every value of a text column reads as, in one scan."""
    candidates = ("int", "bigint", "double", "date", "timestamp", "boolean")
    fits = raw.agg(*[
        how_many(named(c).isNotNull() & ~_reads_as(named(c), t)).alias(f"{i}_{t}")
        for i, c in enumerate(raw.columns) for t in candidates
    ] + [F.count(named(c)).alias(f"{i}_n") for i, c in enumerate(raw.columns)]).first()
    chosen = []
    for i, c in enumerate(raw.columns):
        kind = next((t for t in candidates if fits[f"{i}_n"] and fits[f"{i}_{t}"] == 0), "string")
        chosen.append(named(c).try_cast(kind).alias(c))
    return raw.select(*chosen)


def _reads_as(text: Column, kind: str) -> Column:
    """Whether text is a value of a type as the CSV reader infers it, which is stricter than a cast."""
    forms = {"date": r"^\d{4}-\d{1,2}-\d{1,2}$", "boolean": "(?i)^(true|false)$"}
    fits = text.try_cast(kind).isNotNull()
    return fits & text.rlike(forms[kind]) if kind in forms else fits


def sample(
    df: DataFrame,
    mode: str = "head",
    limit: int = 10_000,
    columns: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``full``: all rows; ``head``: the first rows by key; ``random``: a repeatable random draw.

    The random draw takes the rows with the smallest MD5 of seed and key, so it is the same however
    the rows are partitioned, and in any engine. Both are a top-n: each task keeps only ``limit`` rows.
    """
    kept = resolve_columns(df, columns)
    if mode == "full":
        return df.select(*[named(c) for c in kept])
    if key is None:
        raise ValueError(f"sampling mode '{mode}' needs a key that orders the rows")
    order = [named(k) for k in ([key] if isinstance(key, str) else key)]
    if mode == "random":
        parts = [F.coalesce(o.cast("string"), F.lit("")) for o in order]
        order = [F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), *order]
    elif mode != "head":
        raise ValueError(f"unknown sampling mode '{mode}': use full, head or random")
    return first_rows(df, order, limit).select(*[named(c) for c in kept])


def preview(df: DataFrame, n: int = 10, key: str | Sequence[str] | None = None) -> DataFrame:
    """The first rows, by key when one is given."""
    return first_rows(df, [], n) if key is None else sample(df, "head", n, key=key)


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return local_frame(df.sparkSession, rows, "position int, column string, type string")
