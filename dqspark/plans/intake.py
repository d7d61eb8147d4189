"""One delivery of a channel: its files checked, loaded, put through the channel's suites and judged.

A channel is a dict::

    {"channel_id": "sales_in",
     "files": [{"file_id": "sales", "name": "Monthly sales", "format": "csv", "required": True,
                "alias": "sales", "pattern": "^sales_.*", "expected_columns": ["amount"],
                "schema_validation": True, "schema": "amount double"}],
     "suites": [{"id": "sales_quality", ...}]}
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.operators.scan import first_line
from dqspark.plans.deliveries import verdict
from dqspark.plans.result import SuiteResult, consolidate
from dqspark.plans.suite import run_suites
from dqspark.sources.readers import file_columns, load
from dqspark.sources.registry import DatasetRegistry


@dataclass
class Delivery:
    """What became of a delivery. ``status`` is ERROR, REJECTED, DQ_FAILED or DQ_SUCCESS.

    ``errors`` are those of its files; of its checks, ``errored`` counts those that broke, and
    ``broken`` lists them with their messages.
    """
    submission_id: str
    status: str
    accepted: bool
    errors: list[str] = field(default_factory=list)
    result: SuiteResult | None = None
    errored: int = 0

    @property
    def broken(self) -> DataFrame | None:
        return None if self.result is None else self.result.tests.filter("status = 'ERROR'")

    def release(self) -> None:
        if self.result is not None:
            self.result.release()


def process_delivery(
    spark: SparkSession, channel: Mapping[str, Any], submission_id: str, files: Mapping[str, str],
    *, accept_by_hand: bool = False,
) -> Delivery:
    """Check, load and judge the files of one submission, given as file_id -> path.

    A missing required file, a name that does not fit its pattern, a file that cannot be read or
    lacks expected columns is an error; only a delivery without errors is put through the suites.
    Any errored check makes the delivery an ERROR, whatever the others say. The suites share one scan
    of each file; ``release`` of the delivery lets go of the rows of custom checks.
    """
    specs = {s["file_id"]: s for s in channel["files"]}
    errors = _file_errors(specs, files)
    datasets = {}
    for file_id, path in files.items():
        if errors:
            break
        spec = specs[file_id]
        try:
            datasets[spec.get("alias") or file_id] = _load(spark, spec, path)
        except Exception as error:
            errors.append(f"{spec.get('name', file_id)}: {first_line(error)}")
    if errors:
        return Delivery(submission_id, "ERROR", accept_by_hand, errors)
    registry = DatasetRegistry(spark, datasets)
    suites = channel.get("suites") or []
    if not suites:
        return Delivery(submission_id, "DQ_SUCCESS", True)
    results = [(suite["id"], result) for suite, result in zip(suites, run_suites(spark, registry, suites))]
    merged = results[0][1] if len(results) == 1 else consolidate(results)
    judged = verdict(merged.tests.withColumn("submission_id", F.lit(submission_id))).first()
    status = judged["verdict"] if judged else "DQ_SUCCESS"
    errored = judged["dq_errors"] if judged else 0
    return Delivery(submission_id, status, accept_by_hand or status == "DQ_SUCCESS", [], merged, errored)


def _file_errors(specs: Mapping[str, Mapping[str, Any]], files: Mapping[str, str]) -> list[str]:
    """Files that lack or are misnamed, from the few names the driver was given.

    ``missing_files`` and ``filename_check`` answer the same for tables of many submissions.
    """
    errors = [
        f"required file missing: {spec.get('name', file_id)} ({file_id})"
        for file_id, spec in specs.items() if spec.get("required", True) and file_id not in files]
    for file_id, path in files.items():
        name = posixpath.basename(path.rstrip("/"))
        if file_id not in specs:
            errors.append(f"{name} ({file_id}): no specification")
        elif specs[file_id].get("pattern") and not re.search(specs[file_id]["pattern"], name):
            errors.append(f"{name} ({file_id}): name does not match")
    return errors


def _load(spark: SparkSession, spec: Mapping[str, Any], path: str) -> DataFrame:
    if spec.get("schema_validation"):
        there = set(file_columns(spark, path, spec.get("format"), spec.get("options")))
        absent = [c for c in spec.get("expected_columns") or [] if c not in there]
        if absent:
            raise ValueError(f"columns are missing: {', '.join(absent)}")
    return load(spark, path, spec.get("format"), schema=spec.get("schema"), options=spec.get("options"),
                null_tokens=spec.get("null_tokens") or ())
