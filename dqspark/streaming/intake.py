"""Files checked as they land in a folder."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dqspark.plans.deliveries import verdict
from dqspark.plans.suite import run_suite
from dqspark.sources.sinks import replace_part


def watch_deliveries(
    spark: SparkSession,
    path: str,
    suite: Mapping[str, Any],
    sink: str,
    *,
    schema: T.StructType | str,
    alias: str,
    fmt: str = "csv",
    options: Mapping[str, Any] | None = None,
    checkpoint: str | None = None,
    files_per_batch: int | None = None,
    references: Mapping[str, DataFrame] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run a suite on each batch of files arriving in ``path`` and accept or reject the batch.

    Its metrics, tests and verdict go to tables of these names below ``sink``; with
    ``files_per_batch=1`` every file is a delivery of its own.

    Batches keep no state, so there is no watermark. A batch repeated after a failure writes the
    same ``batch_id`` partitions again and so changes nothing. ``references`` are the other
    datasets the suite reads. The folder's schema is fixed, as a file stream asks for: a CSV file whose
    header names other columns, or the same in another order, ends the query with an error instead of
    being read into the wrong columns.

    What has been read is remembered below ``sink`` unless ``checkpoint`` names another place, so a
    query started again goes on with new files and new batch ids.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    reader = reader.options(**dict(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def check_batch(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        result = run_suite(
            session, {**(references or {}), alias: rows}, suite, run_id=f"batch_{batch_id}", investigations=False)
        decided = verdict(result.tests.withColumn("submission_id", F.lit(f"batch_{batch_id}")))
        for name, table in {"metrics": result.metrics, "tests": result.tests, "verdicts": decided}.items():
            replace_part(table, posixpath.join(sink, name), "batch_id", batch_id)
        result.release()

    writer = (
        reader.load(path).writeStream.foreachBatch(check_batch)
        .option("checkpointLocation", checkpoint or posixpath.join(sink, "_checkpoint")))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
