"""The rows behind the failed tests of a run: totals in one scan per dataset, samples on demand."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from dqspark.functions.exact import breaks
from dqspark.functions.predicates import pick_where, resolve_columns
from dqspark.functions.value_filters import keep_column
from dqspark.functions.values import absent, named
from dqspark.operators import checks, investigate
from dqspark.operators.metrics import EMAIL_PATTERN, METRIC_TYPES, Metric, dates_inside, orphan_count
from dqspark.operators.scan import Frame, Probe, Scan, fold
from dqspark.plans.definition import reference


@dataclass(frozen=True)
class Suspects:
    """The offending rows of one failed test."""
    dataset: str
    description: str
    mask: Column | None = None
    keep: Column | None = None
    duplicates_of: tuple[str, ...] = ()
    digest: bool = False
    orphans_of: tuple | None = None  # key columns, reference rows, reference columns


def _suspects(run, test, planned) -> Suspects | None:
    if test["mode"] == "metric_value":
        metric = run.metrics.get(test["metric_id"])
        if metric is None or metric.dataset not in run.registry:
            return None
        return _metric_suspects(run, metric)
    plan = planned.get(test["id"])
    if plan is None or plan.get("rows") is None and test["type"] != "foreign_key":
        return None
    df = run.registry[test["dataset"]]
    keep, _ = run.keep_of(test, df)
    if test["type"] == "foreign_key":
        ref, ref_column = reference(test)
        return _orphans(test["dataset"], test["columns"], ref, run.registry[ref], ref_column, keep)
    listed = ", ".join(test["columns"])
    if test["type"] == "regex":
        present = [c for c in test["columns"] if c in df.columns]
        if not present:
            return None
        pattern = test.get("pattern") or EMAIL_PATTERN
        misses = [~named(c).cast("string").rlike(pattern) for c in present]
        mask = reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in misses])
        return Suspects(test["dataset"], f"Values not matching {pattern} in {listed}", mask, keep)
    mask = investigate.any_outside(df, test["resolved"], bool(test.get("inclusive", True)))
    limits = ", ".join(f"{c} [{low}, {high}]" for c, (low, high) in test["resolved"].items())
    return Suspects(test["dataset"], f"Values out of bounds: {limits}", mask, keep)


def _metric_suspects(run, metric: Metric) -> Suspects | None:
    df, p = run.registry[metric.dataset], metric.params
    own = METRIC_TYPES[metric.type].own_filter if metric.type in METRIC_TYPES else False
    where = pick_where(p, ("where",)) if own else pick_where(p)
    keep = F.expr(where) if where else None
    if p.get("value_filter"):
        by_value = keep_column(p["value_filter"])
        keep = by_value if keep is None else keep & by_value
    column = p.get("column") or p.get("columns")
    if metric.type == "missing_rate":
        columns = resolve_columns(df, column)
        found = run.values.get(metric.id, {})
        columns = [c for c in columns if found.get(f"{c}_missing_number")] or columns
        return Suspects(metric.dataset, f"Rows with missing values in {', '.join(columns)}",
                         investigate.any_missing(df, columns), keep)
    if metric.type in ("count_where", "count_condition"):
        expr = p.get("expr") or p.get("filter") or p.get("condition")
        return Suspects(metric.dataset, f"Rows matching: {expr}", F.expr(expr), keep)
    if metric.type == "count_out_of_range":
        low, high = p.get("low", 0.01), p.get("high", 1_000_000)
        return Suspects(metric.dataset, f"Values out of bounds: {column} [{low}, {high}]",
                         breaks(df, column, low, high), keep)
    if metric.type == "duplicate_count":
        columns = tuple([column] if isinstance(column, str) else column)
        return Suspects(metric.dataset, f"Rows with a repeated {', '.join(columns)}", None, keep,
                         columns, bool(p.get("digest")))
    if metric.type == "null_rate":
        columns = [column] if isinstance(column, str) else list(column or df.columns)
        return Suspects(metric.dataset, f"Rows with nulls in {', '.join(columns)}", _any([absent(df, c) for c in columns]), keep)
    if metric.type == "avg_completion_rate":
        return Suspects(metric.dataset, "Rows with nulls in any column", _any([absent(df, c) for c in df.columns]), keep)
    if metric.type == "rule_share":
        expr = p.get("expr") or p.get("filter") or p.get("condition")
        return Suspects(metric.dataset, f"Rows not obeying: {expr}", ~F.coalesce(F.expr(expr), F.lit(False)), keep)
    if metric.type == "regex_share":
        name, pattern = _single(column), p.get("pattern") or EMAIL_PATTERN
        misses = F.coalesce(~named(name).cast("string").rlike(pattern), F.lit(False))
        return Suspects(metric.dataset, f"Values not matching {pattern} in {name}", misses, keep)
    if metric.type == "date_share":
        _, inside = dates_inside(df, p)
        return Suspects(metric.dataset, f"Dates missing or out of bounds in {_single(column)}", ~F.coalesce(inside, F.lit(False)), keep)
    if metric.type == "orphan_count" and p.get("ref") in run.registry:
        columns = [column] if isinstance(column, str) else list(column)
        return _orphans(metric.dataset, columns, p["ref"], run.registry[p["ref"]], p.get("ref_column") or columns, keep)
    return None


def _single(column) -> str:
    return column if isinstance(column, str) else column[0]


def _any(masks: list[Column]) -> Column:
    return fold(masks, lambda a, b: a | b)


def _orphans(dataset, columns, ref, ref_df, ref_column, keep) -> Suspects:
    return Suspects(dataset, f"Rows whose {', '.join(columns)} is not in {ref}", None, keep,
                    orphans_of=(tuple(columns), ref_df, ref_column))


def _wanted(run, test) -> bool:
    """Samples are taken unless the test, or the suite for all, says not to."""
    general = test.get("general") or {}
    suite = run.suite.get("general") or run.suite.get("globals") or {}
    for said in (test.get("sample_on_fail"), general.get("sample_on_fail"), suite.get("sample_on_fail")):
        if said is not None:
            return bool(said)
    return True


def sample_failures(run, tests, planned, rows):
    """Per failed test a lazy sample, the samples of each dataset as one frame, and the report's rows.

    A step of a run: it yields the totals it asks for and is sent their answers.
    """
    failed = {r[1] for r in rows if r[8] == "FAIL"}
    found = []
    for test in tests:
        if test["id"] in failed and _wanted(run, test):
            suspects = _suspects(run, test, planned)
            if suspects is not None:
                found.append((test, suspects))
    probes = []
    for test, suspects in found:
        df = run.registry[suspects.dataset]
        if suspects.duplicates_of:
            kept = df if suspects.keep is None else df.filter(suspects.keep)
            total = Frame(investigate.duplicate_total(kept, suspects.duplicates_of, suspects.digest))
        elif suspects.orphans_of:
            kept = df if suspects.keep is None else df.filter(suspects.keep)
            total = Frame(orphan_count(kept, *suspects.orphans_of))
        else:
            total = Scan(lambda scope, mask=suspects.mask: {"value": scope.count_if(mask)})
        probes.append(Probe(test["id"], suspects.dataset, df, total, suspects.keep,
                            f"{run.suite_id} {test['id']}" if suspects.keep is not None else None))
    totals, _ = yield probes
    n, keys = run.sample_rows, run.suite.get("keys") or {}
    samples, report, shared, sampled = {}, [], {}, []
    for test, suspects in found:
        total = int(totals.get(test["id"], {}).get("value") or 0)
        if total == 0:
            continue
        df = run.registry[suspects.dataset]
        key = test.get("sample_key") or keys.get(suspects.dataset)
        order = [key] if isinstance(key, str) else list(key or ())
        kept = df if suspects.keep is None else df.filter(suspects.keep)
        if suspects.duplicates_of or suspects.orphans_of:
            samples[test["id"]] = investigate.investigate_duplicates(
                kept, suspects.duplicates_of, order or df.columns, n, suspects.digest) if suspects.duplicates_of \
                else investigate.investigate_orphans(kept, *suspects.orphans_of, order, n)
            sampled.append(([test["id"]], samples[test["id"]].select(
                F.lit(test["id"]).alias("test_id"), F.struct("*").alias("row"))))
        else:
            mask = suspects.mask if suspects.keep is None else suspects.keep & suspects.mask
            shared.setdefault((suspects.dataset, tuple(order)), {})[test["id"]] = mask
        report.append((test["id"], test["type"], suspects.description, suspects.dataset, total,
                       min(total, n), None))
    for (dataset, order), masks in shared.items():
        frame = investigate.samples_of_masks(run.registry[dataset], masks, order, n)
        sampled.append((list(masks), frame))
        for test_id, mask in masks.items():
            samples[test_id] = investigate.samples_of_masks(
                run.registry[dataset], {test_id: mask}, order, n).select("row.*")
    return samples, sampled, report
