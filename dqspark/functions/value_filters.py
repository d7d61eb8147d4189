"""Named value filters: ordered rules ``column == value -> keep or drop`` and a default.

A filter is a dict::

    {"conditions": [{"column": "region", "type": "S", "value": "North", "result": True}],
     "default": False}
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dqspark.functions.frames import local_frame
from dqspark.functions.types import TYPE_CODES, matches_code, simple_type
from dqspark.functions.values import named

PRECHECK_SCHEMA = T.StructType([
    T.StructField("control_id", T.StringType()),
    T.StructField("control_name", T.StringType()),
    T.StructField("filter_name", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("type_code", T.StringType()),
    T.StructField("criticality", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("result_comments", T.StringType()),
])


def _rules(spec: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Rules in first-seen order; one given twice keeps its place and its last result."""
    rules: dict[tuple, dict[str, Any]] = {}
    for rule in spec.get("conditions") or []:
        if rule.get("column") is None or not isinstance(rule.get("type"), str):
            continue
        code = rule["type"].upper()
        value = rule.get("value")
        key = (rule["column"], code, type(value).__name__, value)
        rules[key] = {
            "column": rule["column"], "code": code, "value": value,
            "result": rule.get("result", False),
        }
    return list(rules.values())


def _hit(rule: Mapping[str, Any]) -> Column:
    """Rows whose column equals the rule's value; a value of another kind equals nothing."""
    code, value = rule["code"], rule["value"]
    if code in ("T", "D"):
        return named(rule["column"]) == F.lit(value).try_cast("timestamp_ntz")
    kinds = {"S": (str,), "B": (bool,)}.get(code, (int, float))
    if not isinstance(value, kinds) or (isinstance(value, bool) and code != "B"):
        return F.lit(False)
    return named(rule["column"]) == F.lit(value)


def keep_column(spec: Mapping[str, Any]) -> Column:
    """True for the rows a filter keeps. A null equals no rule's value."""
    chain = None
    for rule in _rules(spec):
        hit = _hit(rule)
        verdict = F.lit(bool(rule["result"]))
        chain = F.when(hit, verdict) if chain is None else chain.when(hit, verdict)
    default = F.lit(bool(spec.get("default", False)))
    return default if chain is None else chain.otherwise(default)


def apply_value_filter(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    return df.filter(keep_column(spec))


def check_value_filter(schema: T.StructType, spec: Mapping[str, Any]) -> list[str]:
    """Problems that make a filter unusable on this schema; empty when it may run."""
    problems = []
    defaults = spec.get("default")
    if "default" not in spec:
        problems.append("the filter needs a default")
    elif isinstance(defaults, (list, tuple)):
        problems.append(f"the filter has {len(defaults)} defaults, exactly one is expected")
    elif not isinstance(defaults, bool):
        problems.append("the default must be true or false")
    types = {f.name: f.dataType for f in schema.fields}
    for rule in _rules(spec):
        name, code = rule["column"], rule["code"]
        if not isinstance(rule["result"], bool):
            problems.append(f"the result of the rule on '{name}' must be true or false")
        if name not in types:
            problems.append(f"column '{name}' is not in the dataset")
        elif code not in TYPE_CODES:
            problems.append(f"unknown type code '{code}' for '{name}'")
        elif not matches_code(types[name], code):
            problems.append(
                f"type of '{name}' does not fit: expected {code}, found {simple_type(types[name])}"
            )
    return problems


def value_filter_prechecks(
    spark: SparkSession, name: str, schema: T.StructType, spec: Mapping[str, Any],
    stream: str = "", zone: str = "", criticality: str = "High",
) -> tuple[DataFrame, str | None]:
    """One row per rule and one for the default, and the reason the filter is blocked, if it is."""
    problems = check_value_filter(schema, spec)
    reason = " ; ".join(problems) if problems else None
    # Fixed formats: a control id such as STR_ZON_T-001, and a control's name.
    prefix = f"{stream[:3].upper()}_{zone[:3].upper()}"
    entries = [(r["column"], r["code"], f"{r['column']}::D={r['code']}") for r in _rules(spec)]
    if "default" in spec:
        entries.append((None, None, "ELSE default"))
    rows = [
        (f"{prefix}_T-{i:03d}", f"[FILTER: {name}] {label}", name, column, code, criticality,
         "Fail" if problems else "Pass", reason or "OK")
        for i, (column, code, label) in enumerate(entries, start=1)
    ]
    return local_frame(spark, rows, PRECHECK_SCHEMA), reason
