"""Evaluating many scalar aggregates with as few scans as possible.

Everything a suite wants to know about one dataset (metric values, violation counts, sample
totals) is a :class:`Probe`. Probes of the same dataset share one ``agg``; questions about key
frequencies share one ``groupBy`` per key; the rest bring their own one-row frame. The frames are
united, so Spark runs their stages side by side in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
    IllegalArgumentException, NumberFormatException, PySparkException, PythonException,
)
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.predicates import Scope
from dqspark.functions.values import key_digest, named

Values = Mapping[str, Column]

# Aggregates one scan computes. Spark generates code for up to a hundred columns; beyond that, reading
# the columns again for the next lot costs less than interpreting every aggregate for every row.
SCAN_AGGREGATES = 90


@dataclass(frozen=True)
class Scan:
    """Aggregates over the dataset's rows; ``table`` names those that make up an output row."""
    build: Callable[[Scope], Values]
    value: str = "value"
    table: Mapping[str, str] | None = None


@dataclass(frozen=True)
class Keys:
    """Aggregates over the frequency table of some key columns, whose count column is ``n``."""
    columns: tuple[str, ...]
    build: Callable[[DataFrame], Values]
    value: str = "value"
    digest: bool = False


@dataclass(frozen=True)
class Frame:
    """A one-row frame of numbers from a job of its own."""
    frame: DataFrame
    value: str = "value"


@dataclass(frozen=True)
class Table:
    """A grouped output table; it has no scalar."""
    frame: DataFrame


@dataclass(frozen=True)
class Probe:
    key: str
    dataset: str
    df: DataFrame
    ask: Scan | Keys | Frame
    keep: Column | None = None
    keep_id: str | None = None

    def check(self) -> None:
        """Analysis only: raises when the probe does not fit its dataset."""
        for frame, _ in _wide_frames([self]):
            frame.schema


def frequencies(df: DataFrame, columns: Sequence[str], digest: bool = False) -> DataFrame:
    """Key columns and ``n``; nulls are one key. Counts are partly summed before the shuffle."""
    keys = key_digest(df, columns) if digest else [named(c) for c in columns]
    return df.select(*keys).groupBy(*[named(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


def _wide_frames(
    probes: Iterable[Probe], details: bool = True,
) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    """One-row frames with columns s0, s1, ... and, for each, which probe and name they answer.

    Without ``details`` each probe answers with its value alone.
    """
    scans: dict[str, list[Probe]] = {}
    keyed: dict[tuple, list[Probe]] = {}
    frames = []
    for probe in probes:
        if isinstance(probe.ask, Scan):
            scans.setdefault(probe.dataset, []).append(probe)
        elif isinstance(probe.ask, Keys):
            group = (probe.dataset, probe.keep_id, probe.ask.columns, probe.ask.digest)
            keyed.setdefault(group, []).append(probe)
        else:
            slots = probe.ask.frame.columns if details else [probe.ask.value]
            frames.append((
                probe.ask.frame.select(*[named(c).alias(f"s{i}") for i, c in enumerate(slots)]),
                [(probe.key, c) for c in slots],
            ))
    for group in scans.values():
        df = group[0].df
        # A condition all probes share goes in front, where it can reach the files.
        shared = group[0].keep_id is not None and len({p.keep_id for p in group}) == 1
        if shared:
            df = df.filter(group[0].keep)
        asked = [(p, p.ask.build(Scope(None if shared else p.keep))) for p in group]
        frames += [_aggregate(df, lot, details) for lot in _lots(asked, details)]
    for (_, _, columns, digest), group in keyed.items():
        df = group[0].df if group[0].keep is None else group[0].df.filter(group[0].keep)
        counted = frequencies(df, columns, digest)
        frames.append(_aggregate(counted, [(p, p.ask.build(counted)) for p in group], details))
    return frames


def _lots(asked, details):
    """Probes in lots of at most SCAN_AGGREGATES aggregates; a larger probe is a lot of its own."""
    lots, size = [], 0
    for probe, values in asked:
        wanted = len(values) if details else 1
        if not lots or size + wanted > SCAN_AGGREGATES:
            lots.append([])
            size = 0
        lots[-1].append((probe, values))
        size += wanted
    return lots


def _aggregate(df, asked, details):
    slots = [
        (probe.key, name, column) for probe, values in asked for name, column in values.items()
        if details or name == probe.ask.value
    ]
    frame = df.agg(*[column.alias(f"s{i}") for i, (_, _, column) in enumerate(slots)])
    return frame, [(key, name) for key, name, _ in slots]


def long_values(probes: Sequence[Probe], details: bool = True) -> DataFrame:
    """All answers as rows (key, name, value, exact), lazily.

    ``exact`` is the text of an integer, a decimal or a moment; a moment has no ``value``.
    """
    parts = []
    for frame, slots in _wide_frames(probes, details):
        parts.append(frame.select(F.inline(answer_cells(
            frame, [(f"s{i}", {"key": key, "name": name}) for i, (key, name) in enumerate(slots)]))))
    return reduce(DataFrame.unionByName, parts)


def answer_cells(frame: DataFrame, cells: Sequence[tuple[str, Mapping[str, str]]]) -> Column:
    """Columns of aggregates as an array of structs: the names each goes by, its ``value`` and its ``exact`` text."""
    kinds, structs = dict(frame.dtypes), []
    for column, names in cells:
        kind = kinds[column]
        moment = kind.startswith(("date", "timestamp"))
        exact = moment or kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")
        value = "cast(null as double)" if moment else f"cast({column} as double)"
        text = f"cast({column} as string)" if exact else "cast(null as string)"
        structs.append("struct({}, {} as value, {} as exact)".format(
            ", ".join(f"{_quoted(v)} as {k}" for k, v in names.items()), value, text))
    return F.expr(f"array({', '.join(structs)})")


def _quoted(text: str) -> str:
    """A SQL string literal; the escaped dollar keeps Spark from reading ``${...}`` as a variable."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def collect_values(
    probes: Sequence[Probe],
) -> tuple[dict[str, dict[str, float | None]], dict[str, str]]:
    """All answers by probe key, and the error of each probe that failed.

    Only these numbers reach the driver; how many there are depends on the suite, not on the data.
    Probes the analyzer refuses are set aside before anything runs.
    """
    if not probes:
        return {}, {}
    errors: dict[str, str] = {}
    try:
        united = long_values(probes)
    except Exception:
        good = []
        for probe in probes:
            try:
                probe.check()
                good.append(probe)
            except Exception as error:
                errors[probe.key] = first_line(error)
        if not good:
            return {}, errors
        probes, united = good, long_values(good)
    answers, failed = _run(probes, united)
    return answers, errors | failed


def _run(probes: Sequence[Probe], united: DataFrame):
    """Answers from one job, or from few if a value breaks an expression in one of the probes.

    The guilty probe is searched by halves: if the first half runs, the second holds it and need not be
    run as it is. Halves that are no longer suspected are answered together, in one job. Any other
    failure, such as that of a cluster, is no probe's fault and is raised.
    """
    answers, errors, waiting = {}, {}, list(probes)
    while waiting:
        suspects, waiting = waiting, []
        try:
            return answers | _gather(long_values(suspects) if united is None else united), errors
        except Exception as error:
            if not breaks_a_value(error):
                raise
            last, united = error, None
        while len(suspects) > 1:
            first, second = suspects[:len(suspects) // 2], suspects[len(suspects) // 2:]
            try:
                answers |= _gather(long_values(first))
                suspects = second
            except Exception as error:
                if not breaks_a_value(error):
                    raise
                last, suspects, waiting = error, first, waiting + second
        errors[suspects[0].key] = first_line(last)
    return answers, errors


def breaks_a_value(error: BaseException) -> bool:
    """Whether an error comes from data an expression cannot take, so that asking again without it helps."""
    if isinstance(error, (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
                          NumberFormatException, PythonException, AnalysisException)):
        return True
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    return bool(state) and state.startswith(("22", "42"))


class Found(dict):
    """The numbers of a probe by name; ``exact`` holds the text of those known beyond a double."""

    def __init__(self):
        super().__init__()
        self.exact: dict[str, str] = {}


def _gather(df: DataFrame) -> dict[str, Found]:
    answers: dict[str, Found] = {}
    for row in df.collect():
        found = answers.setdefault(row["key"], Found())
        found[row["name"]] = row["value"]
        if row["exact"] is not None:
            found.exact[row["name"]] = row["exact"]
    return answers


def first_line(error: BaseException) -> str:
    text = str(error.args[0]) if isinstance(error, KeyError) and error.args else str(error)
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    return lines[0] if lines else type(error).__name__


def fold(columns: Sequence[Column], join: Callable[[Column, Column], Column]) -> Column:
    """Join many columns as a balanced tree, so that wide tables do not nest expressions deeply."""
    columns = list(columns)
    while len(columns) > 1:
        columns = [
            join(columns[i], columns[i + 1]) if i + 1 < len(columns) else columns[i]
            for i in range(0, len(columns), 2)
        ]
    return columns[0]
