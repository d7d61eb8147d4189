"""Every operator applied to whole tables of the test data, with the same question in SQL beside it."""

from examples import checks, deliveries, event_time, exact, levels, metrics, ordered, sketches, sources, suites, together

MODULES = (sources, metrics, checks, suites, deliveries, exact, event_time, sketches, levels, ordered, together)


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
