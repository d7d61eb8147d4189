"""Where intermediate tables go."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for intermediate tables in the shared folder the cluster names.

    Only a local session without that setting falls back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="dqspark-")
    return posixpath.join(shared, f"{purpose}-{uuid.uuid4().hex}")


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor costs no new computation."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
