"""Running a suite: metrics, then tests, then samples of the offending rows."""

from __future__ import annotations

import uuid
from collections.abc import Generator, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dqspark.functions.frames import local_frame
from dqspark.functions.predicates import pick_where, predicate_columns
from dqspark.functions.value_filters import check_value_filter, keep_column, value_filter_prechecks
from dqspark.operators import checks, custom, investigate
from dqspark.operators.metrics import Metric, build_probe, declared_output, orphan_count
from dqspark.operators.scan import Found, Frame, Probe, Scan, Table, collect_values, first_line
from dqspark.plans.definition import (
    info_rows, metric_of, reference, refuse_shared_ids, split_rules, suite_items, test_of,
)
from dqspark.plans.result import (
    DETAILS_SCHEMA, EXACT_METRICS_SCHEMA, INFO_SCHEMA, INVESTIGATIONS_SCHEMA, TESTS_SCHEMA, SuiteResult,
)
from dqspark.plans.samples import sample_failures
from dqspark.sources.registry import VIRTUAL, DatasetRegistry

_ON_METRIC = ("interval_check", "range", "threshold")
_ON_COLUMNS = ("interval_check", "range", "regex")


class _Run:
    """The state of one run: what to compute, and what is already decided."""

    def __init__(self, spark, registry, suite, sample_rows):
        self.spark, self.registry, self.suite, self.sample_rows = spark, registry, suite, sample_rows
        self.suite_id = suite.get("id") or "suite"
        self.metrics: dict[str, Metric] = {}
        self.metric_status: dict[str, tuple[str, str | None]] = {}
        self.metric_ask: dict[str, Probe | Table] = {}
        self.values: dict[str, dict[str, float | None]] = {}
        self.test_rows: list[tuple] = []
        self.prechecks: list[DataFrame] = []

    def dataset_of(self, name: str | None) -> str:
        """The dataset named, else the only one there is."""
        if name:
            return name
        known = [a for a in self.registry if not a.startswith(VIRTUAL)]
        if len(known) == 1:
            return known[0]
        raise ValueError("no dataset is named and there is more than one")

    def plan_metric(self, metric: Metric) -> None:
        self.metrics[metric.id] = metric
        try:
            metric.dataset = self.dataset_of(metric.dataset)
            df = self.registry[metric.dataset]
            self._name_filter(metric)
            spec = metric.params.get("value_filter")
            if spec:
                frame, reason = value_filter_prechecks(
                    self.spark, metric.params.get("filter_name") or "value_filter", df.schema, spec,
                    metric.params.get("stream") or "", metric.params.get("zone") or "")
                self.prechecks.append(frame.withColumn("metric_id", F.lit(metric.id)))
                if reason:
                    self.metric_status[metric.id] = ("BLOCKED", reason)
                    return
            made = build_probe(metric, df, self.registry)
            if isinstance(made, Table):
                alias = self.registry.add_virtual(metric.id, made.frame)
                rows = Scan(lambda scope: {"value": scope.rows()})
                made = Probe(_metric_key(metric.id), alias, made.frame, rows)
            else:
                made = replace(made, key=_metric_key(metric.id), dataset=metric.dataset)
            self.metric_ask[metric.id] = made
        except Exception as error:
            self.metric_status[metric.id] = ("ERROR", first_line(error))

    def _name_filter(self, metric: Metric) -> None:
        """A filter may be the name of one of the suite's value filters, or such a filter itself."""
        given, known = metric.params.get("filter"), self.suite.get("filters") or {}
        if isinstance(given, Mapping):
            metric.params["value_filter"] = metric.params.pop("filter")
        elif isinstance(given, str) and given in known:
            metric.params["filter_name"] = metric.params.pop("filter")
            metric.params["value_filter"] = known[given]

    def keep_of(self, test, df: DataFrame) -> tuple[Column | None, str | None]:
        """The rows a test looks at, by its condition or by a value filter, given or named, and a name for them."""
        given, known = test.get("filter"), self.suite.get("filters") or {}
        spec = given if isinstance(given, Mapping) else known.get(given) if isinstance(given, str) else None
        plain = test if spec is None else {k: v for k, v in test.items() if k != "filter"}
        where = pick_where(plain)
        keep = F.expr(where) if where else None
        if spec is not None:
            problems = check_value_filter(df.schema, spec)
            if problems:
                raise ValueError(" ; ".join(problems))
            by_value = keep_column(spec)
            keep = by_value if keep is None else keep & by_value
        name = None if keep is None else f"where {where} filter {spec}"
        return keep, name

    def settle_metrics(self, answers, errors) -> None:
        for mid, probe in self.metric_ask.items():
            key = _metric_key(mid)
            if key in errors:
                self.metric_status[mid] = ("ERROR", errors[key])
                continue
            self.metric_status[mid] = ("SUCCESS", None)
            self.values[mid] = answers.get(key) or Found()
            table = probe.ask.table if isinstance(probe.ask, Scan) else None
            if table:
                schema = ", ".join(
                    f"`{c.replace('`', '``')}` {'bigint' if kind == 'int' else 'double'}"
                    for c, kind in table.items())
                row = [int(self.values[mid][c]) if kind == "int" else self.values[mid][c]
                       for c, kind in table.items()]
                self.registry.add_virtual(mid, local_frame(self.spark, [row], schema))

    def metric_rows(self) -> list[tuple]:
        rows = []
        for mid, metric in self.metrics.items():
            status, error = self.metric_status[mid]
            probe = self.metric_ask.get(mid)
            found = self.values.get(mid) or Found()
            value, exact = (x.get(probe.ask.value) if probe is not None and status == "SUCCESS" else None
                            for x in (found, found.exact))
            rows.append((self.suite_id, mid, metric.type, metric.dataset, metric.column_text(), value, status, error, exact))
        return rows

    def verdict(self, test, passed, status, message, value=None) -> None:
        columns = ", ".join(test["columns"]) or None
        self.test_rows.append((
            self.suite_id, test["id"], test["type"], test["metric_id"], test["dataset"], columns,
            value, passed, status, message, test["severity"], test["blocking"]))


def _metric_key(metric_id: str) -> str:
    return f"m {metric_id}"


def _test_key(test_id: str) -> str:
    return f"t {test_id}"


def run_suite(
    spark: SparkSession,
    datasets: DatasetRegistry | Mapping[str, DataFrame],
    suite: Mapping[str, Any],
    *,
    run_id: str | None = None,
    technical_checks: bool = False,
    investigations: bool = True,
    sample_rows: int | None = None,
) -> SuiteResult:
    """Compute a suite's metrics, verdicts and samples.

    Everything asked of a dataset, by metrics and by tests, is answered in one shared scan of it;
    only those numbers reach the driver, and the result tables are made of them, so that reading
    a report never scans a dataset again. Samples stay lazy until read or written.
    """
    registry = datasets if isinstance(datasets, DatasetRegistry) else DatasetRegistry(spark, datasets)
    return _together([_steps(spark, registry, suite, run_id, technical_checks, investigations, sample_rows)])[0]


def run_suites(
    spark: SparkSession,
    datasets: DatasetRegistry | Mapping[str, DataFrame],
    suites: Sequence[Mapping[str, Any]],
    *,
    run_id: str | None = None,
    technical_checks: bool = False,
    investigations: bool = True,
    sample_rows: int | None = None,
) -> list[SuiteResult]:
    """Several suites over the same datasets, whose questions to a dataset share one scan; a result for each.

    Suites go through their phases side by side. The tables that their metrics make are their own: a suite
    does not see ``virtual:`` datasets of another one.
    """
    registry = datasets if isinstance(datasets, DatasetRegistry) else DatasetRegistry(spark, datasets)
    ids = [s.get("id") or "suite" for s in suites]
    if len(set(ids)) < len(ids):
        raise ValueError(f"suites share an id: {sorted(i for i in set(ids) if ids.count(i) > 1)}")
    return _together([_steps(spark, registry.copy(), s, run_id, technical_checks, investigations, sample_rows) for s in suites])


def _together(runs: Sequence[Generator[list, tuple, SuiteResult]]) -> list[SuiteResult]:
    """Results of runs that each yield what they ask and are sent the answers and errors.

    What all runs ask at one step is asked at once, so that probes of one dataset share its scan.
    """
    results: list[SuiteResult | None] = [None] * len(runs)
    replies: dict[int, tuple | None] = dict.fromkeys(range(len(runs)))
    while replies:
        asked: dict[int, list] = {}
        for i, reply in replies.items():
            try:
                asked[i] = runs[i].send(reply)
            except StopIteration as done:
                results[i] = done.value
        answers, errors = collect_values([_of_run(i, p) for i, probes in asked.items() for p in probes])
        replies = {i: tuple({p.key: given[f"{i} {p.key}"] for p in probes if f"{i} {p.key}" in given} for given in (answers, errors))
                   for i, probes in asked.items()}
    return results


def _of_run(i: int, probe: Probe) -> Probe:
    """A probe under a name of its own among those of several runs, and on a dataset of its own if its run made it."""
    own = probe.dataset.startswith(VIRTUAL)
    return replace(probe, key=f"{i} {probe.key}", dataset=f"{i} {probe.dataset}" if own else probe.dataset)


def _steps(spark, registry, suite, run_id, technical_checks, investigations, sample_rows):
    """One suite's run, which yields the probes of each phase and is sent their answers and errors."""
    settings = suite.get("globals") or {}
    run = _Run(spark, registry, suite, sample_rows or settings.get("sample_size") or investigate.SAMPLE_ROWS)
    context = suite.get("context") or {}
    metric_items, test_items = suite_items(suite)
    refuse_shared_ids([i["id"] for i in metric_items],
                      [i["id"] for i in test_items] + [s["id"] for s in suite.get("scripts") or [] if s.get("id")])
    severity = settings.get("default_severity", "medium")
    tests = [t for item in test_items for t in split_rules(test_of(item, severity))]
    held: list[DataFrame] = []
    scripts = _Scripts(run, held)
    scripts.phase("pre_dq")

    for item in metric_items:
        run.plan_metric(metric_of(item, context))
    column_tests = [t for t in tests if t["mode"] == "dataset_columns" and t["type"] in _ON_COLUMNS]
    key_tests = [t for t in tests if t["type"] == "foreign_key"]
    first, planned = [], {}
    for test in column_tests + key_tests:
        if _waits(run, test):
            continue
        probe = _plan_test(run, test, planned)
        if probe is not None:
            first.append(probe)
    answers, errors = yield list(run.metric_ask.values()) + first
    run.settle_metrics(answers, errors)

    second = []
    for test in column_tests:
        if test["id"] not in planned and test["dataset"] and test["dataset"].startswith(VIRTUAL):
            probe = _plan_virtual(run, test, planned)
            if probe is not None:
                second.append(probe)
    late, late_errors = yield second
    answers, errors = answers | late, errors | late_errors

    metrics = local_frame(spark, run.metric_rows(), EXACT_METRICS_SCHEMA)
    parts = [_metric_verdicts(run, tests, metrics), _column_verdicts(run, planned, answers, errors)]
    _schema_verdicts(run, tests, planned)
    if technical_checks:
        _technical_verdicts(run, tests)
    scripts.phase("independent")
    scripts.phase("post_dq")
    parts.append(local_frame(spark, run.test_rows, TESTS_SCHEMA))
    decided = reduce(DataFrame.unionByName, [p for p in parts if p is not None]).collect()
    technical = [r for r in run.test_rows if r[2].startswith("filter_")]
    rows = _in_suite_order([tuple(r) for r in decided], [t["id"] for t in tests])
    tests_df = local_frame(spark, rows, TESTS_SCHEMA)

    samples, sampled, report = {}, [], []
    if investigations:
        samples, sampled, report = yield from sample_failures(run, tests, planned, rows)
    info = info_rows(metric_items, tests) + [
        ("test", r[1], r[1], r[9], "", True, "", "", "Technical", f"TECH_{r[1]}") for r in technical
    ]
    details = [(m, name, v) for m, found in run.values.items() for name, v in found.items()]
    for made in scripts.measures:
        metrics = metrics.unionByName(made, allowMissingColumns=True)
    for made in scripts.verdicts:
        tests_df = tests_df.unionByName(made)
    return SuiteResult(
        spark=spark, suite_id=run.suite_id, run_id=run_id or f"run_{uuid.uuid4().hex[:12]}",
        metrics=metrics, tests=tests_df, details=local_frame(spark, details, DETAILS_SCHEMA),
        info=local_frame(spark, info, INFO_SCHEMA),
        investigations=local_frame(spark, report, INVESTIGATIONS_SCHEMA), samples=samples, sampled=sampled,
        tables={a: registry[a] for a in registry if a.startswith(VIRTUAL)},
        prechecks=reduce(DataFrame.unionByName, run.prechecks) if run.prechecks else None,
        scripts=scripts.count, held=held,
    )


def _in_suite_order(rows: list[tuple], ids: list[str]) -> list[tuple]:
    place = {test_id: i for i, test_id in enumerate(ids)}
    return sorted(rows, key=lambda r: (place.get(r[1], len(ids)), r[1]))


# --- tests

def _waits(run: _Run, test) -> bool:
    """Whether a test reads a metric's output that is only known once metrics have run."""
    name = test["dataset"] or ""
    return name.startswith(VIRTUAL) and name not in run.registry


def _plan_test(run: _Run, test, planned) -> Probe | None:
    try:
        test["dataset"] = run.dataset_of(test["dataset"])
        df = run.registry[test["dataset"]]
        if test["type"] == "foreign_key":
            ref, ref_column = reference(test)
            if ref not in run.registry:
                raise KeyError(f"reference dataset '{ref}' is unknown")
            keep, _ = run.keep_of(test, df)
            rows = df if keep is None else df.filter(keep)
            ask = Frame(orphan_count(rows, test["columns"], run.registry[ref], ref_column))
            probe = Probe(_test_key(test["id"]), test["dataset"], df, ask)
            planned[test["id"]] = {"test": test, "rows": None}
        else:
            rows, scan = _column_scan(df, test)
            keep, keep_id = run.keep_of(test, df)
            probe = Probe(_test_key(test["id"]), test["dataset"], df, scan, keep, keep_id)
            planned[test["id"]] = {"test": test, "rows": rows}
            if all(r["state"] == "missing" for r in rows):
                return None
        return probe
    except Exception as error:
        planned.pop(test["id"], None)
        planned[test["id"]] = {"test": test, "error": first_line(error)}
        return None


def _plan_virtual(run: _Run, test, planned) -> Probe | None:
    source = test["dataset"][len(VIRTUAL):]
    status, error = run.metric_status.get(source, (None, None))
    if status is not None and status != "SUCCESS":
        reason = f"Metric '{source}' is {status}" + (f": {error}" if error else "")
        planned[test["id"]] = {"test": test, "skipped": reason}
        return None
    return _plan_test(run, test, planned)


def _column_scan(df: DataFrame, test):
    if test["type"] == "regex":
        if not test["columns"]:
            raise ValueError("select at least one column")
        return checks.regex_scan(df, test["columns"], test.get("pattern"))
    bounds = checks.resolve_bounds(
        test["columns"], test["lower"], test["upper"], test.get("column_rules") or ())
    if not bounds:
        raise ValueError("select at least one column or define column_rules to evaluate")
    if all(b == (None, None) for b in bounds.values()):
        raise ValueError(checks.NO_BOUND)
    test["columns"] = list(bounds)
    test["resolved"] = bounds
    return checks.bounds_scan(df, bounds, bool(test.get("inclusive", True)))


def _metric_verdicts(run: _Run, tests, metrics: DataFrame) -> DataFrame | None:
    chosen = [t for t in tests if t["mode"] == "metric_value" and t["type"] in _ON_METRIC]
    if not chosen:
        return None
    judged = checks.metric_checks(checks.metric_tests(run.spark, chosen), metrics)
    return _with_spec(run, judged, chosen)


def _with_spec(run: _Run, judged: DataFrame, tests) -> DataFrame:
    spec = local_frame(
        run.spark, [(t["id"], t["severity"], t["blocking"]) for t in tests],
        "test_id string, severity string, blocking boolean")
    return judged.join(spec, "test_id").select(
        F.lit(run.suite_id).alias("suite_id"), "test_id", "type", "metric_id", "dataset", "column",
        "value", "passed", "status", "message", "severity", "blocking")


def _column_verdicts(run: _Run, planned, answers, errors) -> DataFrame | None:
    counts, judged = [], []
    for test_id, plan in planned.items():
        test, key = plan["test"], _test_key(test_id)
        failed = plan.get("error") or errors.get(key)
        if failed:
            run.verdict(test, False, "ERROR", failed)
        elif "skipped" in plan:
            run.verdict(test, None, "SKIPPED", plan["skipped"])
        elif test["type"] == "foreign_key":
            orphans = answers[key]["value"]
            ref, _ = reference(test)
            text = "OK" if orphans == 0 else f"{int(orphans)} rows refer to no row of '{ref}'"
            run.verdict(test, orphans == 0, "SUCCESS" if orphans == 0 else "FAIL", text, orphans)
        else:
            counts += checks.count_rows(test_id, plan["rows"], answers.get(key, {}))
            judged.append(test)
    if not judged:
        return None
    spec = local_frame(run.spark, [
        (t["id"], t["type"], t["metric_id"], t["dataset"], ", ".join(t["columns"])) for t in judged
    ], "test_id string, type string, metric_id string, dataset string, column string")
    found = checks.verdicts(local_frame(run.spark, counts, checks.COUNTS_SCHEMA))
    return _with_spec(run, found.join(spec, "test_id"), judged)


def _schema_verdicts(run: _Run, tests, planned) -> None:
    for test in tests:
        kind = test["type"]
        try:
            if kind == "output_schema":
                _output_schema_verdict(run, test)
            elif kind in ("columns_present", "columns_typed"):
                test["dataset"] = run.dataset_of(test["dataset"])
                df = run.registry[test["dataset"]]
                facts = (checks.presence_facts(df, test["columns"]) if kind == "columns_present"
                         else checks.type_facts(df, test["types"]))
                _from_facts(run, test, facts)
            elif kind not in (*_ON_METRIC, *_ON_COLUMNS, "foreign_key"):
                run.verdict(test, False, "ERROR", f"Unknown test type: {kind}")
            elif kind == "threshold" and test["mode"] != "metric_value":
                run.verdict(test, False, "FAIL", "The test names no metric.")
            elif kind == "regex" and test["mode"] == "metric_value":
                run.verdict(test, False, "ERROR", "A pattern applies to dataset columns only.")
            elif test["mode"] not in ("metric_value", "dataset_columns"):
                run.verdict(test, False, "FAIL", f"Unsupported target mode '{test['mode']}'.")
        except Exception as error:
            run.verdict(test, False, "ERROR", first_line(error))


def _output_schema_verdict(run: _Run, test) -> None:
    source = test["metric_id"]
    status, error = run.metric_status.get(source, (None, None))
    if status is None:
        return run.verdict(test, False, "FAIL", f"Metric '{source}'{checks.NOT_FOUND}")
    if status != "SUCCESS":
        return run.verdict(test, None, "SKIPPED", f"Metric '{source}' is {status}: {error}")
    metric = run.metrics[source]
    declared = test.get("declared") or declared_output(metric, run.registry[metric.dataset])
    alias = VIRTUAL + source
    if not declared or alias not in run.registry:
        return run.verdict(test, False, "FAIL", f"Metric '{source}' declares no output table.")
    test["dataset"] = alias
    return _from_facts(run, test, checks.output_schema_facts(run.registry[alias], declared))


def _from_facts(run: _Run, test, facts) -> None:
    wrong = [f[4] for f in facts if not f[3]]
    run.verdict(test, not wrong, "FAIL" if wrong else "SUCCESS", "; ".join(wrong) or "OK", float(len(wrong)))


def _technical_verdicts(run: _Run, tests) -> None:
    """For each test with a condition: do its columns exist, and does it fit their types?"""
    for test in tests:
        where = pick_where(test)
        dataset = test["dataset"] or getattr(run.metrics.get(test["metric_id"]), "dataset", None)
        if not where or not dataset or dataset not in run.registry:
            continue
        df = run.registry[dataset]
        base = {**test, "dataset": dataset, "metric_id": None, "blocking": True, "severity": "high"}
        try:
            columns = predicate_columns(run.spark, where, df)
        except AnalysisException as error:
            columns, problem = [], first_line(error)
        else:
            problem = None
        base["columns"] = columns
        absent = [c for c in columns if c not in df.columns]
        _from_facts(
            run, {**base, "id": f"{test['id']}_implicit_columns_presence", "type": "filter_columns_presence"},
            [(c, "", "", c not in absent, f"column '{c}' is missing") for c in columns])
        if problem is None and not absent:
            try:
                df.filter(F.expr(where)).schema
            except AnalysisException as error:
                problem = first_line(error)
        elif absent:
            problem = f"columns are missing: {', '.join(absent)}"
        _from_facts(
            run, {**base, "id": f"{test['id']}_implicit_columns_type", "type": "filter_columns_type_match"},
            [(None, "", "", problem is None, problem)])


# --- custom checks

class _Scripts:
    """The suite's custom checks, each run once, in its phase."""

    def __init__(self, run: _Run, held: list[DataFrame]):
        self.run, self.held = run, held
        self.specs = run.suite.get("scripts") or []
        self.count = 0
        self.measures: list[DataFrame] = []
        self.verdicts: list[DataFrame] = []
        for spec in self.specs:
            if spec.get("execute_on", "post_dq") not in custom.PHASES:
                raise ValueError(f"unknown phase of script '{spec.get('id')}': {spec['execute_on']}")

    def phase(self, name: str) -> None:
        for spec in self.specs:
            if spec.get("execute_on", "post_dq") == name:
                self._one(spec)

    def _one(self, spec) -> None:
        run = self.run
        row = {"id": spec["id"], "type": "custom", "metric_id": None, "dataset": None, "columns": [],
               "severity": spec.get("severity", "medium"), "blocking": bool(spec.get("blocking"))}
        if spec.get("enabled") is False:
            return run.verdict(row, None, "SKIPPED", "The script is disabled.")
        self.count += 1
        values = {m: found.get(run.metric_ask[m].ask.value) for m, found in run.values.items()}
        context = custom.CheckContext(run.spark, run.registry, values)
        try:
            made = custom.run_check(spec.get("check") or spec["id"], context, spec.get("params")).persist()
            self.held.append(made)
            made.count()  # a check that fails while running is an error of the suite, not of its reader
        except Exception as error:
            return run.verdict(row, False, "ERROR", first_line(error))
        suite = F.lit(run.suite_id).alias("suite_id")
        nothing = F.lit(None).cast("string")
        self.measures.append(made.filter("passed is null").select(
            suite, F.col("id").alias("metric_id"), F.lit("custom").alias("type"),
            nothing.alias("dataset"), nothing.alias("column"), "value",
            F.lit("SUCCESS").alias("status"), nothing.alias("error")))
        self.verdicts.append(made.filter("passed is not null").select(
            suite, F.col("id").alias("test_id"), F.lit("custom").alias("type"),
            nothing.alias("metric_id"), nothing.alias("dataset"), nothing.alias("column"), "value",
            "passed", F.when(F.col("passed"), "SUCCESS").otherwise("FAIL").alias("status"), "message",
            F.lit(row["severity"]).alias("severity"), F.lit(row["blocking"]).alias("blocking")))
