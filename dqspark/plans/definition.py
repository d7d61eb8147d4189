"""Suites as their authors write them, and as the runner reads them.

A suite is a plain dict::

    {"id": "sales_quality",
     "context": {"stream": "A", "project": "P1", "zone": "raw"},
     "metrics": [{"id": "m", "type": "missing_rate", "dataset": "sales", "column": "amount"}],
     "tests": [{"id": "t", "type": "interval_check", "metric_id": "m", "upper": 0.1}],
     "scripts": [{"id": "s", "check": "name", "params": {}, "execute_on": "post_dq"}],
     "filters": {"north": {"conditions": [...], "default": False}},
     "keys": {"sales": "sale_id"}}

``metrics`` and ``tests`` may also be mappings from id to body, and parameters may sit under
``specific``. ``filters`` are named value filters a metric's ``filter`` may refer to, and ``keys``
name the columns that order the samples of a dataset.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from typing import Any

from dqspark.functions.predicates import pick_where
from dqspark.operators.metrics import Metric, default_id
from dqspark.sources.registry import VIRTUAL

# Keys of a metric that describe it rather than parametrize it.
_DESCRIPTIVE = ("id", "type", "dataset", "database", "value_from_dataset", "nature", "general",
                "identification")


def flat_items(section: Any) -> list[dict[str, Any]]:
    """Metrics or tests as flat dicts, in order."""
    if isinstance(section, Mapping):
        section = [{"id": key, **body} for key, body in section.items()]
    flat = []
    for item in section or []:
        item = {**item, **(item.get("specific") or {}), **(item.get("params") or {})}
        item.pop("specific", None)
        item.pop("params", None)
        item["dataset"] = next(
            (item[k] for k in ("dataset", "database", "value_from_dataset") if item.get(k)), None)
        flat.append(item)
    return flat


def metric_of(item: dict[str, Any], context: Mapping[str, Any]) -> Metric:
    params = {k: v for k, v in item.items() if k not in _DESCRIPTIVE}
    for k in ("stream", "project", "zone"):
        if not params.get(k) and context.get(k):
            params[k] = context[k]
    return Metric(item["type"], item.get("id"), item.get("dataset"), **params)


def _number(value: Any) -> Any:
    return None if value == "" else value


def _first_of(item: Mapping[str, Any], *names: str) -> Any:
    return next((_number(item[n]) for n in names if item.get(n) is not None), None)


def suite_items(suite: Mapping[str, Any]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """The metrics and the tests of a suite as flat dicts, each with its id and dataset."""
    metrics, context = flat_items(suite.get("metrics")), suite.get("context") or {}
    for item in metrics:
        if not item.get("id"):
            item["id"] = default_id(item.get("type"), item.get("dataset"), {**context, **item})
    return metrics, flat_items(suite.get("tests"))


def refuse_shared_ids(metrics: list[str], tests: list[str]) -> None:
    shared = sorted(i for i, n in Counter(metrics + tests).items() if n > 1)
    if shared:
        raise ValueError(f"ids used more than once in the suite: {shared}")


def test_of(item: dict[str, Any], severity: str = "medium") -> dict[str, Any]:
    """One test with its bounds, operator and target under the names the checks use."""
    test = dict(item)
    general = item.get("general") or {}
    bounds = item.get("bounds") or {}
    test["metric_id"] = _first_of(item, "metric_id", "metric", "associated_metric_id") or (
        general.get("associated_metric_id"))
    for side, names in (("lower", ("lower", "low", "min")), ("upper", ("upper", "high", "max"))):
        test[side] = _first_of({**bounds, **item}, *names)
        # A bound written as lower_value or upper_value counts only when it is switched on.
        if test[side] is None and item.get(f"{side}_enabled"):
            test[side] = _number(item.get(f"{side}_value"))
        if item.get(f"{side}_enabled") is False:
            test[side] = None
    threshold = item.get("threshold")
    if isinstance(threshold, Mapping):
        test["op"], test["target"] = threshold.get("op"), _number(threshold.get("value"))
    elif threshold is not None:
        test["op"], test["target"] = "=", threshold
    else:
        test["op"] = _first_of(item, "operator", "op") or "="
        test["target"] = _first_of(item, "value", "target")
    columns = item.get("columns") or item.get("column") or []
    test["columns"] = [columns] if isinstance(columns, str) else list(columns)
    test["severity"] = item.get("severity") or general.get("criticality") or severity
    test["blocking"] = bool(item.get("stop_on_failure", general.get("stop_on_failure", False)))
    mode = item.get("target_mode")
    test["mode"] = mode or ("metric_value" if test["metric_id"] else "dataset_columns")
    return test


def split_rules(test: dict[str, Any]) -> list[dict[str, Any]]:
    """Column rules of a metric test address the metric's output table."""
    rules = test.get("column_rules") or []
    if test["mode"] != "metric_value" or not rules or not test["metric_id"]:
        return [test]
    on_table = {**test, "mode": "dataset_columns", "dataset": VIRTUAL + test["metric_id"]}
    if test["lower"] is None and test["upper"] is None:
        return [on_table]
    return [test, {**on_table, "id": f"{test['id']}:columns", "lower": None, "upper": None}]


def info_rows(metrics, tests) -> list[tuple]:
    rows = []
    for kind, items in (("metric", metrics), ("test", tests)):
        for item in items:
            nature, general = item.get("nature") or {}, item.get("general") or {}
            ident = item.get("identification") or {}
            rows.append((
                kind, item["id"], nature.get("name") or item.get("name") or ident.get("control_name") or "",
                nature.get("description") or item.get("description") or "",
                nature.get("comments") or nature.get("preliminary_comments") or "",
                bool(general.get("export", True)), general.get("owner", ""), _condition_text(item),
                item.get("category") or nature.get("category")
                or nature.get("functional_category_1") or "Business",
                ident.get("control_id") or ident.get("test_id") or item["id"],
            ))
    return rows


def _condition_text(item) -> str:
    condition = pick_where(item) or ""
    return condition if isinstance(condition, str) else "value filter"


def reference(test) -> tuple[str, str | Sequence[str]]:
    """Reference dataset and column, given apart or as 'dataset.column'."""
    ref = test.get("ref") or test.get("ref_dataset")
    column = test.get("ref_column")
    if not column and isinstance(ref, str) and "." in ref:
        ref, column = ref.rsplit(".", 1)
    return ref, column or test["columns"]
