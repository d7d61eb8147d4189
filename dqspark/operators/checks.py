"""Tests: pass or fail verdicts over metric values and over dataset columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dqspark.functions.exact import Bound, breaks, outside  # noqa: F401
from dqspark.functions.frames import local_frame
from dqspark.functions.predicates import Scope
from dqspark.functions.types import OUTPUT_TYPES, TYPE_CODES, matches_code, simple_type
from dqspark.functions.values import field_of, named, number, number_text
from dqspark.operators.metrics import EMAIL_PATTERN
from dqspark.operators.scan import Scan

METRIC_TEST_SCHEMA = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("metric_id", T.StringType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
    T.StructField("inclusive", T.BooleanType()),
    T.StructField("op", T.StringType()),
    T.StructField("target", T.DoubleType()),
    T.StructField("spec_error", T.StringType()),
    T.StructField("lower_exact", T.StringType()),    # the bounds as they were written
    T.StructField("upper_exact", T.StringType()),
    T.StructField("target_exact", T.StringType()),
])

COUNTS_SCHEMA = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
    T.StructField("state", T.StringType()),      # checked, missing or unbounded
    T.StructField("problem", T.StringType()),    # wording of a violation
    T.StructField("needs_values", T.BooleanType()),
    T.StructField("checked", T.LongType()),
    T.StructField("violations", T.LongType()),
])

# Comparison operators a threshold may name.
OPERATORS = ("=", "==", "!=", ">=", "<=", ">", "<")

# The wording of verdicts, which reports and their readers rely on.
OK = "OK"
NO_BOUND = "Define at least one bound (min or max)."
INCOMPARABLE = "Incomparable types: "
NOT_FOUND = " not found or not computed."
BELOW = " < min "
ABOVE = " > max "
OUT_OF_RANGE = " out of range "
OUT_OF_BOUNDS = "out of bounds in"
MISSING_COLUMNS = "Missing columns: "
NO_NUMBERS = "Columns without numeric values: "
UNBOUNDED = "No bounds configured for: "
ALL_VALUES = "All values ("
WITHIN_BOUNDS = ") respect the configured bounds."


# --- tests on a metric's value

def bound(value: Any) -> Bound:
    """A bound as a number; NaN, which nothing exceeds, is none."""
    number_ = Bound(value)
    if number_ != number_:
        raise ValueError(f"{INCOMPARABLE}'{value}' is not a number")
    return number_


def metric_tests(spark: SparkSession, specs: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Test specifications as rows; a bound that is no number is kept as the row's error."""
    return local_frame(spark, [_metric_test_row(s) for s in specs], METRIC_TEST_SCHEMA)


def _metric_test_row(spec: Mapping[str, Any]) -> tuple:
    kind = spec["type"]
    bounds: dict[str, float | None] = {"lower": None, "upper": None, "target": None}
    error = None
    for name in bounds:
        value = spec.get(name)
        try:
            bounds[name] = None if value is None else bound(value)
        except (TypeError, ValueError):
            error = f"{INCOMPARABLE}'{value}' is not a number"
    op = spec.get("op")
    if error is None and kind == "threshold":
        if op not in OPERATORS:
            error = f"Unknown operator '{op}'."
        elif bounds["target"] is None:
            error = "A threshold needs a value."
    if error is None and kind == "range" and None in (bounds["lower"], bounds["upper"]):
        error = f"{INCOMPARABLE}a range needs both bounds"
    if error is None and kind == "interval_check" and bounds["lower"] is bounds["upper"] is None:
        error = NO_BOUND
    if error is None and not spec.get("metric_id"):
        error = "The test names no metric."
    exact = [None if b is None else format(b.exact, "f") for b in bounds.values()]
    return (spec["id"], kind, spec.get("metric_id"), bounds["lower"], bounds["upper"],
            bool(spec.get("inclusive", True)), op, bounds["target"], error, *exact)


def _against(limit: str) -> str:
    """SQL for the sign of a metric's value less a limit: exact where both are known so, else of doubles."""
    exact, other = (f"try_cast({x} as decimal(38, 18))" for x in ("exact", f"{limit}_exact"))
    return (f"case when {exact} < {other} then -1 when {exact} > {other} then 1 when {exact} = {other} then 0 "
            f"when found < {limit} then -1 when found > {limit} then 1 when found = {limit} then 0 end as to_{limit}")


def _plainly(value: str, exact: str) -> str:
    """SQL for a number as people write it, all digits of a large one that is known exactly."""
    return f"if({exact} is not null and abs({value}) >= 9007199254740992D, {exact}, {number_text(value)})"


def metric_checks(tests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Verdicts of tests on metric values: (test_id, type, metric_id, dataset, column, value,
    passed, status, message).

    A test whose metric did not succeed is SKIPPED with the reason; one whose metric is unknown or
    has no value fails. Values that ``metrics`` also gives as text in ``exact`` are compared exactly.
    """
    exact = "exact" if "exact" in metrics.columns else "cast(null as string) as exact"
    known = metrics.selectExpr(
        "metric_id", "dataset", "column", "value as found", "status as metric_status", "error", exact)
    value = _plainly("found", "exact")
    lower, upper, target = (_plainly(c, f"{c}_exact") for c in ("lower", "upper", "target"))
    outcome = """case
        when spec_error is not null or metric_status is null then 'FAIL'
        when metric_status <> 'SUCCESS' then 'SKIPPED'
        when found is null or isnan(found) then 'FAIL'
        when type = 'interval_check' then
            if(coalesce(to_lower < 0, false) or coalesce(to_upper > 0, false), 'FAIL', 'SUCCESS')
        when type = 'range' then
            if((inclusive and to_lower >= 0 and to_upper <= 0) or (to_lower > 0 and to_upper < 0), 'SUCCESS', 'FAIL')
        when case op when '=' then to_target = 0 when '==' then to_target = 0 when '!=' then to_target <> 0
             when '>=' then to_target >= 0 when '<=' then to_target <= 0
             when '>' then to_target > 0 else to_target < 0 end then 'SUCCESS'
        else 'FAIL' end"""
    message = f"""case
        when spec_error is not null then spec_error
        when metric_status is null then concat("Metric '", metric_id, "'{NOT_FOUND}")
        when status = 'SKIPPED' then concat_ws(': ', concat("Metric '", metric_id, "' is ", metric_status), error)
        when found is null or isnan(found) then concat("Metric '", metric_id, "' has no numeric value.")
        when status = 'SUCCESS' then '{OK}'
        when type = 'interval_check' then concat_ws('; ',
            if(to_lower < 0, concat({value}, '{BELOW}', {lower}), null),
            if(to_upper > 0, concat({value}, '{ABOVE}', {upper}), null))
        when type = 'range' then concat('value ', {value}, '{OUT_OF_RANGE}', if(inclusive, '[', '('),
            {lower}, ', ', {upper}, if(inclusive, ']', ')'))
        else concat({value}, ' is not ', op, ' ', {target}) end"""
    return (
        tests.join(known, "metric_id", "left").selectExpr("*", *[_against(c) for c in ("lower", "upper", "target")])
        .selectExpr("*", f"{outcome} as status")
        .selectExpr(
            "test_id", "type", "metric_id", "dataset", "column",
            "if(spec_error is null and not isnan(found), found, null) as value",
            "if(status = 'SKIPPED', null, status = 'SUCCESS') as passed", "status", f"{message} as message"))


# --- tests on dataset columns

def resolve_bounds(
    columns: Sequence[str], lower: float | None, upper: float | None,
    column_rules: Sequence[Mapping[str, Any]] = (),
) -> dict[str, tuple[float | None, float | None]]:
    """Bounds per column. A rule replaces both bounds of its columns; the last rule wins."""
    overrides = {}
    for rule in column_rules:
        low = rule["lower"] if rule.get("lower") is not None else rule.get("lower_value")
        high = rule["upper"] if rule.get("upper") is not None else rule.get("upper_value")
        for c in rule.get("columns") or []:
            if c:
                overrides[c] = (low, high)
    names = dict.fromkeys([c for c in columns if c] + list(overrides))
    return {
        c: tuple(None if b is None else bound(b) for b in overrides.get(c, (lower, upper)))
        for c in names
    }


def bounds_scan(
    df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]], inclusive: bool = True,
) -> tuple[list[dict[str, Any]], Scan]:
    """What to report per column, and the aggregates ``i_checked`` and ``i_violations`` behind it."""
    rows = []
    for c, (low, high) in bounds.items():
        state = "missing" if c not in df.columns else (
            "unbounded" if low is None and high is None else "checked")
        rows.append({"column": c, "lower": low, "upper": high, "state": state,
                     "problem": OUT_OF_BOUNDS, "needs_values": True})

    def build(scope: Scope):
        values = {}
        for i, row in enumerate(rows):
            if row["state"] == "missing":
                continue
            value = number(df, row["column"])
            values[f"{i}_checked"] = scope.count_if(value.isNotNull())
            if row["state"] == "checked":
                values[f"{i}_violations"] = scope.count_if(
                    breaks(df, row["column"], row["lower"], row["upper"], inclusive))
        return values
    return rows, Scan(build)


def regex_scan(
    df: DataFrame, columns: Sequence[str], pattern: str | None = None,
) -> tuple[list[dict[str, Any]], Scan]:
    """The same for a pattern that every non-null value must match."""
    rows = [{"column": c, "lower": None, "upper": None,
             "state": "checked" if c in df.columns else "missing",
             "problem": "not matching in", "needs_values": False} for c in columns]

    def build(scope):
        values = {}
        for i, row in enumerate(rows):
            if row["state"] == "checked":
                text = named(row["column"]).cast("string")
                values[f"{i}_checked"] = scope.count_if(text.isNotNull())
                values[f"{i}_violations"] = scope.count_if(~text.rlike(pattern or EMAIL_PATTERN))
        return values
    return rows, Scan(build)


def count_rows(
    test_id: str, rows: Sequence[Mapping[str, Any]], answers: Mapping[str, float | None],
) -> list[tuple]:
    """COUNTS_SCHEMA rows from collected answers."""
    return [
        (test_id, r["column"], r["lower"], r["upper"], r["state"], r["problem"], r["needs_values"],
         int(answers.get(f"{i}_checked") or 0), int(answers.get(f"{i}_violations") or 0))
        for i, r in enumerate(rows)
    ]


def _counts(df: DataFrame, test_id: str, rows, scan: Scan, where: str | None) -> DataFrame:
    """COUNTS_SCHEMA rows computed lazily: one aggregate over the rows, unfolded into its columns."""
    values = scan.build(Scope())
    if not values:
        return local_frame(df.sparkSession, count_rows(test_id, rows, {}), COUNTS_SCHEMA)
    counted = (df.filter(F.expr(where)) if where else df).agg(*[c.alias(n) for n, c in values.items()])

    def cell(field: T.StructField, i: int, row) -> Column:
        if field.name in ("checked", "violations"):
            name = f"{i}_{field.name}"
            value = named(name) if name in values else F.lit(0)
        else:
            value = F.lit(test_id if field.name == "test_id" else row[field.name])
        return value.cast(field.dataType).alias(field.name)

    return counted.select(F.inline(F.array(*[
        F.struct(*[cell(f, i, row) for f in COUNTS_SCHEMA.fields]) for i, row in enumerate(rows)
    ])))


def verdicts(counts: DataFrame) -> DataFrame:
    """One row per test from its per-column counts: (test_id, value, passed, status, message).

    Messages list columns in name order, so they read the same however rows were partitioned.
    """
    no_numbers = "state <> 'missing' and needs_values and checked = 0"

    def listed(condition: str) -> str:
        return f"array_join(sort_array(collect_set(column) filter (where {condition})), ', ')"

    broken = "state = 'checked' and violations > 0"
    part = """struct(column, concat(violations, '/', checked, ' ', problem, " '", column, "'") as text)"""
    grouped = counts.groupBy("test_id").agg(*[F.expr(e) for e in (
        "coalesce(sum(violations) filter (where state = 'checked'), 0) as bad", "sum(checked) as seen",
        f"count(*) filter (where state = 'missing' or {no_numbers}) as unusable",
        f"{listed('state = ' + repr('missing'))} as missing",
        f"transform(sort_array(collect_list({part}) filter (where {broken})), p -> p.text) as broken",
        f"{listed(no_numbers)} as empty",
        f"{listed('state = ' + repr('unbounded') + ' and checked > 0')} as unbounded",
        "first(needs_values) as numeric")])
    return grouped.selectExpr(
        "test_id", "cast(bad as double) as value", "bad = 0 and unusable = 0 as passed",
        f"""concat_ws('; ', if(missing <> '', concat('{MISSING_COLUMNS}', missing), null),
            if(size(broken) > 0, array_join(broken, '; '), null),
            if(empty <> '', concat('{NO_NUMBERS}', empty), null),
            if(unbounded <> '', concat('{UNBOUNDED}', unbounded), null)) as problems""",
        f"concat('{ALL_VALUES}', seen, if(numeric, '{WITHIN_BOUNDS}', ') match.')) as fine",
    ).selectExpr("test_id", "value", "passed", "if(passed, 'SUCCESS', 'FAIL') as status",
                 "if(problems = '', fine, problems) as message")


def interval_check_columns(
    df: DataFrame, columns: Sequence[str], lower: float | None = None, upper: float | None = None,
    column_rules: Sequence[Mapping[str, Any]] = (), *, inclusive: bool = True,
    where: str | None = None, test_id: str = "interval_check", per_column: bool = False,
) -> DataFrame:
    """Numeric values outside their bounds, per column or as one verdict; one scan."""
    bounds = resolve_bounds(columns, lower, upper, column_rules)
    if not bounds:
        raise ValueError("select at least one column or give column_rules")
    if all(low is None and high is None for low, high in bounds.values()):
        raise ValueError("define at least one bound (min or max)")
    counts = _counts(df, test_id, *bounds_scan(df, bounds, inclusive), where)
    return counts if per_column else verdicts(counts)


def range_columns(
    df: DataFrame, columns: Sequence[str], low: float, high: float, inclusive: bool = True,
    **options: Any,
) -> DataFrame:
    options.setdefault("test_id", "range")
    return interval_check_columns(df, columns, low, high, inclusive=inclusive, **options)


def regex_check(
    df: DataFrame, column: str | Sequence[str], pattern: str | None = None, *,
    where: str | None = None, test_id: str = "regex", per_column: bool = False,
) -> DataFrame:
    """Non-null values that do not match a Java regular expression."""
    columns = [column] if isinstance(column, str) else list(column)
    counts = _counts(df, test_id, *regex_scan(df, columns, pattern), where)
    return counts if per_column else verdicts(counts)


# --- tests on schemas, decided without a scan

_FACTS_SCHEMA = "column string, expected string, actual string, passed boolean, message string"


def columns_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return local_frame(df.sparkSession, presence_facts(df, columns), _FACTS_SCHEMA)


def columns_typed(df: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    return local_frame(df.sparkSession, type_facts(df, codes), _FACTS_SCHEMA)


def presence_facts(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    return [
        (c, "present", "present" if c in df.columns else "missing", c in df.columns,
         "OK" if c in df.columns else f"column '{c}' is missing") for c in columns
    ]


def type_facts(df: DataFrame, codes: Mapping[str, str]) -> list[tuple]:
    facts = []
    for c, code in codes.items():
        if c not in df.columns:
            facts.append((c, code, "missing", False, f"column '{c}' is missing"))
            continue
        kind = field_of(df, c).dataType
        good = matches_code(kind, code)
        why = "OK" if good else f"'{c}' is {simple_type(kind)}, expected {code.upper()}"
        if code.upper() not in TYPE_CODES:
            why = f"unknown type code '{code}' for '{c}'"
        facts.append((c, code.upper(), simple_type(kind), good, why))
    return facts


def output_schema_facts(df: DataFrame, declared: Mapping[str, str]) -> list[tuple]:
    """Declared columns that are missing or of another type, and columns nobody declared."""
    facts = []
    for c in sorted(set(declared) | set(df.columns)):
        if c not in df.columns:
            facts.append((c, declared[c], "missing", False, f"column '{c}' is missing"))
        elif c not in declared:
            kind = field_of(df, c).dataType.simpleString()
            facts.append((c, "none", kind, False, f"column '{c}' is unexpected"))
        else:
            wanted, kind = OUTPUT_TYPES[declared[c]], field_of(df, c).dataType
            good = kind == wanted or (
                simple_type(kind) == simple_type(wanted) and declared[c] in ("int", "float", "date"))
            facts.append((c, declared[c], kind.simpleString(), good, "OK" if good else
                          f"'{c}' is {kind.simpleString()}, declared {declared[c]}"))
    return facts


def assert_output_schema(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    return local_frame(df.sparkSession, output_schema_facts(df, declared), _FACTS_SCHEMA)
