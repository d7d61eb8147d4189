"""Where results and samples go."""

from __future__ import annotations

import posixpath
from typing import TYPE_CHECKING
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions.frames import local_frame
from dqspark.functions.value_filters import PRECHECK_SCHEMA

if TYPE_CHECKING:
    from dqspark.plans.result import SuiteResult

def write_sample(df: DataFrame, folder: str, test_id: str, suffix: str, stamp: str) -> str:
    """One sample as CSV with a header; returns its path."""
    path = posixpath.join(folder, f"{test_id}_{suffix}_{stamp}.csv")
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_results(result: SuiteResult, path: str, fmt: str = "parquet") -> dict[str, str]:
    """The tables of a run, one folder each, partitioned by run_id; returns their paths.

    A rerun replaces its own partition of every table and no other, also where it has nothing to
    write now. Samples are whole, as JSON rows so that samples of different datasets fit one table;
    those of one dataset are drawn in one scan of it.
    """
    samples = local_frame(result.spark, [], "test_id string, row string")
    for _, frame in result.sampled:
        samples = samples.unionByName(frame.select("test_id", F.to_json("row").alias("row")))
    prechecks = result.prechecks
    if prechecks is None:
        prechecks = local_frame(result.spark, [], PRECHECK_SCHEMA).withColumn("metric_id", F.lit(None).cast("string"))
    written = {}
    for name, df in {
        "summary": result.summary(), "metrics": result.metrics, "tests": result.tests,
        "details": result.details, "investigations": result.investigations,
        "prechecks": prechecks, "samples": samples,
    }.items():
        written[name] = posixpath.join(path, name)
        replace_part(df, written[name], "run_id", result.run_id, fmt)
    return written


def part_exists(spark: SparkSession, path: str, part: str | None = None, value: str | int | None = None) -> bool:
    """Whether a Parquet table, or one partition of it, has been written."""
    folder = path if part is None else posixpath.join(path, f"{part}={quote(str(value), safe=' -_.~')}")
    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def replace_part(df: DataFrame, path: str, part: str, value: str | int, fmt: str = "parquet") -> None:
    """Make a frame's rows the whole of one partition of a table, in files of a sensible size.

    The partition's own folder is overwritten, so that no rows are left in it if there are none now.
    """
    folder = posixpath.join(path, f"{part}={quote(str(value), safe=' -_.~')}")
    df.hint("rebalance").write.mode("overwrite").format(fmt).save(folder)
