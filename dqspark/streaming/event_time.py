"""Metrics over windows of event time, and expected files that never came, on streams."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dqspark.functions.predicates import Scope
from dqspark.functions.values import named
from dqspark.operators.metrics import Metric, build_probe
from dqspark.operators.scan import Probe, Scan, answer_cells
from dqspark.sources.sinks import part_exists, replace_part


@dataclass(frozen=True)
class Windows:
    """Tumbling windows of ``size``, sliding ones with ``slide``, or sessions that end after a ``gap`` without rows.

    Durations are texts such as ``10 minutes``.
    """
    size: str | None = None
    slide: str | None = None
    gap: str | None = None

    def __post_init__(self):
        if (self.size is None) == (self.gap is None) or (self.slide and not self.size):
            raise ValueError("windows need a size, or a gap alone")

    def of(self, time: str) -> Column:
        if self.gap:
            return F.session_window(named(time), self.gap)
        return F.window(named(time), self.size, self.slide) if self.slide else F.window(named(time), self.size)

    def closes(self, time: str) -> Column:
        """When the last window that a row belongs to ends."""
        if self.gap:
            return named(time) + F.expr(f"interval {self.gap}")
        step = F.window(named(time), self.slide or self.size)
        return step["start"] + F.expr(f"interval {self.size}")


def window_metrics(df: DataFrame, metrics: Sequence[Metric], windows: Windows, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics by window and keys: (window_start, window_end, keys, metric_id, value, exact).

    ``df`` may be a stream with a watermark on ``time``; a metric must be an aggregate over rows, as only such
    are kept in a few numbers a window.
    """
    cells = []
    for m in metrics:
        made = build_probe(m, df, {}, "")
        if not isinstance(made, Probe) or not isinstance(made.ask, Scan):
            raise ValueError(f"metric '{m.id}' is no aggregate over rows")
        cells.append((m.id, made.ask.build(Scope(made.keep))[made.ask.value]))
    found = df.where(named(time).isNotNull()).groupBy(windows.of(time).alias("__w"), *[named(k) for k in keys]).agg(
        *[column.alias(f"s{i}") for i, (_, column) in enumerate(cells)])
    answers = answer_cells(found, [(f"s{i}", {"metric_id": mid}) for i, (mid, _) in enumerate(cells)])
    return found.select(
        F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[named(k) for k in keys], F.inline(answers))


def advance_windows(
    spark: SparkSession, path: str, metrics: Sequence[Metric], windows: Windows, sink: str, *,
    schema: T.StructType | str, time: str, keys: Sequence[str] = (), delay: str = "10 minutes", fmt: str = "parquet",
    options: Mapping[str, Any] | None = None,
) -> None:
    """Take in what has landed in ``path`` since the last call, and write the windows that are over by now.

    Two streams below ``sink`` take turns. The first sorts new rows: those whose windows were all over, ``delay``
    after the latest time of the calls before, go to ``late``, those without a time to ``untimed``, the others to
    ``accepted``; ``arrivals`` counts them for every batch. The second keeps open windows in its state store and
    writes each window once, to ``windows``, when the watermark passes its end: no later row can change it.

    All state is below ``sink``, so any call may be the first of a new session. A batch that is repeated after a
    failure replaces its own parts; one that was sorted to the end is not sorted again.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**dict(options or {}))
    clock = posixpath.join(sink, "arrivals")

    def sort_batch(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        if part_exists(session, clock, "batch_id", batch_id):
            return
        over = F.lit(False)
        if part_exists(session, clock):
            seen = session.read.parquet(clock).where(F.col("batch_id") < batch_id).agg(F.max("latest")).scalar()
            over = windows.closes(time) <= seen - F.expr(f"interval {delay}")
        fate = F.when(named(time).isNull(), "untimed").when(over, "late").otherwise("accepted")
        sorted_ = rows.withColumn("__fate", fate).persist()
        for name in ("late", "untimed", "accepted"):
            replace_part(sorted_.where(F.col("__fate") == name).drop("__fate"), posixpath.join(sink, name), "batch_id", batch_id)
        counts = sorted_.agg(
            *[F.count_if(F.col("__fate") == name).alias(name) for name in ("accepted", "late", "untimed")],
            F.max(named(time)).alias("latest"))
        replace_part(counts, clock, "batch_id", batch_id)
        sorted_.unpersist()

    gate = reader.load(path).writeStream.foreachBatch(sort_batch).option(
        "checkpointLocation", posixpath.join(sink, "_sorting")).trigger(availableNow=True).start()
    gate.awaitTermination()
    accepted = posixpath.join(sink, "accepted")
    if not part_exists(spark, accepted):
        return
    stream = spark.readStream.schema(spark.read.parquet(accepted).schema).parquet(accepted).withWatermark(time, delay)
    _write(window_metrics(stream, metrics, windows, time, keys), posixpath.join(sink, "windows"), posixpath.join(sink, "_windows"))


def _write(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything a stream has to say by now, each batch a part of a table."""
    query = stream.writeStream.outputMode("append").foreachBatch(
        lambda rows, batch_id: replace_part(rows, sink, "batch_id", batch_id)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def overdue(
    expected: DataFrame, arrived: DataFrame, key: Sequence[str], due: str, at: str, within: str, early: str = "0 seconds",
) -> DataFrame:
    """Expected files with each arrival from ``early`` before they are due until ``within`` after; null if none.

    Columns of ``expected``, then ``arrived_at``. Both sides may be streams with watermarks on ``due`` and
    ``at``: a file that has not come is a row as soon as the watermark says that it no longer can.
    """
    came = arrived.select(*[named(k).alias(f"__{k}") for k in key], named(at).alias("arrived_at"))
    same = F.lit(True)
    for k in key:
        same = same & (named(k) == named(f"__{k}"))
    inside = (F.col("arrived_at") >= named(due) - F.expr(f"interval {early}")) & (
        F.col("arrived_at") <= named(due) + F.expr(f"interval {within}"))
    return expected.join(came, same & inside, "left_outer").select(*[named(c) for c in expected.columns], "arrived_at")


def advance_overdue(
    spark: SparkSession, expected_path: str, arrived_path: str, sink: str, *, expected_schema: T.StructType | str,
    arrived_schema: T.StructType | str, key: Sequence[str], due: str, at: str, within: str, early: str = "0 seconds",
    delay: str = "0 seconds", fmt: str = "parquet", options: Mapping[str, Any] | None = None,
) -> None:
    """Take in expected files and arrivals that have landed since the last call; write what is decided to ``files``.

    An outer join of two streams keeps what is undecided in its state store. ``arrived_at`` is null for a
    file that did not come in time; as arrivals may be ``delay`` late, it is written once both streams have passed
    the end of its interval by that. All state is below ``sink``.
    """
    def stream(path, schema, time):
        reader = spark.readStream.format(fmt).schema(schema).options(**dict(options or {}))
        return reader.load(path).where(named(time).isNotNull()).withWatermark(time, delay)

    found = overdue(stream(expected_path, expected_schema, due), stream(arrived_path, arrived_schema, at), key, due, at, within, early)
    _write(found, posixpath.join(sink, "files"), posixpath.join(sink, "_files"))
