"""The test tables, and derived ones with planted defects written the same way for Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Customers with missing segments (nulls and blanks) and missing balances.
DIRTY_COLUMNS = (
    "c_custkey",
    "case when c_custkey % 10 = 0 then null when c_custkey % 15 = 7 then ' ' "
    "else c_mktsegment end as c_mktsegment",
    "case when c_custkey % 20 = 3 then null else c_acctbal end as c_acctbal",
)
DIRTY_SQL = f"select {', '.join(DIRTY_COLUMNS)} from customer"


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*DIRTY_COLUMNS)


# Order dates as text, some of them not dates.
DATED_COLUMNS = (
    "o_orderkey",
    "case when o_orderkey % 25 = 4 then 'invalid_date' "
    "else substr(cast(o_orderdate as {text}), 1, 10) end as order_date",
)


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[c.format(text="string") for c in DATED_COLUMNS])


DATED_SQL = "select {} from orders".format(", ".join(c.format(text="varchar") for c in DATED_COLUMNS))

MISSING_SEGMENT = "c_mktsegment is null or trim(c_mktsegment) = ''"
