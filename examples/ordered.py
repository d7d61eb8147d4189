"""Rows in an order within a key: trailing frames, balances, periods, and references valid at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark import Metric
from dqspark.operators import as_of, balances, compute_metrics, merged_periods, orphans_at, overlaps, trailing
from examples.tables import table

# Events with half of the rows on one user, and some without any.
HOT = "case when event_id % 2 = 0 then 0 when event_id % 31 = 0 then null else user_id end as user_id"
EVENT_COLUMNS = ("event_id", "ts", HOT, "event_type", "cast(round(value * 100) as bigint) as cents")


def _events(spark, sf):
    return table(spark, sf, "events").selectExpr(*EVENT_COLUMNS)


def trailing_frames(spark, sf):
    """Each event beside the seven before it of its user."""
    found = trailing(_events(spark, sf), "user_id", ["ts", "event_id"], 7, lambda w: {
        "previous": F.lag("event_id", 1).over(w), "seventh": F.lag("event_id", 7).over(w),
        "total": F.sum("cents").over(w.rowsBetween(-7, -1)), "dearest": F.max("cents").over(w.rowsBetween(-7, 0))})
    return found.select("event_id", "user_id", "previous", "seventh", F.col("total").cast("bigint").alias("total"), "dearest")


# Clicks are paid in, all else is paid out.
SIGNED = "case when event_type = 'click' then cents * 4 else -cents end as amount"


def running_balances(spark, sf):
    rows = _events(spark, sf).selectExpr("event_id", "ts", "user_id", SIGNED)
    return balances(rows, "user_id", ["ts", "event_id"], "amount").select("event_id", F.col("balance").cast("bigint").alias("balance"))


# An event lasts for as many seconds as it costs; some are open, some end before they begin.
PERIOD_COLUMNS = (
    "user_id", "case when event_id % 997 = 3 then null else ts end as start",
    "case when event_id % 499 = 5 then null when event_id % 101 = 7 then ts - interval 1 hour else ts + interval 1 second * cents end as finish")


def _periods(spark, sf):
    once = _events(spark, sf).selectExpr(*PERIOD_COLUMNS)
    return once.union(once.where("minute(finish) = 30"))


def overlapping_periods(spark, sf):
    """Equal periods are one row; some come twice."""
    return overlaps(_periods(spark, sf), "user_id", "start", "finish")


def merged_stretches(spark, sf):
    return merged_periods(_periods(spark, sf), "user_id", "start", "finish")


# A user's state changes with every event but views; it is known until the next one, some changes end earlier.
VERSIONS = "event_type <> 'view'"


def events_as_of(spark, sf):
    """Views beside the last other event of their user."""
    events = _events(spark, sf)
    found = as_of(events.where("event_type = 'view'"), events.where(VERSIONS), "user_id", "ts", "ts", name="state")
    return found.select("event_id", "user_id", F.col("state.event_id").alias("state_id"), F.col("state.event_type").alias("state_type"))


def orphans_at_time(spark, sf):
    """Views whose user's last other event is over, or has not come."""
    events = _events(spark, sf)
    states = events.where(VERSIONS).selectExpr("user_id as id", "ts as since", "ts + interval 1 second * (cents * 3) as until")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return orphans_at(views, ["user_id"], "ts", states, "since", "until", ["id"]).select("event_id")


def ordered_metrics(spark, sf):
    """The same checks as metrics of a suite, one of them with a condition."""
    events = _events(spark, sf).selectExpr("event_id", "ts", "user_id", "event_type", "cents", SIGNED, *PERIOD_COLUMNS[1:])
    states = events.where(VERSIONS).select("user_id", F.col("ts").alias("since"))
    return compute_metrics(events, [
        Metric("gap_count", id="gaps", by="user_id", order="ts", longest=3600),
        Metric("gap_count", id="gaps_of_clicks", by="user_id", order="ts", longest=7200, where="event_type = 'click'"),
        Metric("jump_count", id="jumps", by="user_id", order=["ts", "event_id"], column="cents", n=4, tolerance=800),
        Metric("balance_breaches", id="overdrawn", by="user_id", order=["ts", "event_id"], column="amount", lower=0),
        Metric("overlap_count", id="overlaps", by="user_id", start="start", end="finish"),
        Metric("orphan_count_at", id="stateless", column="user_id", at="ts", ref="states", ref_since="since"),
    ], {"states": states})


QUERIES = {f.__name__: f for f in (
    trailing_frames, running_balances, overlapping_periods, merged_stretches, events_as_of, orphans_at_time, ordered_metrics)}

_EVENTS = f"select {', '.join(EVENT_COLUMNS)} from events"
_ONCE = f"select {', '.join(PERIOD_COLUMNS)} from ({_EVENTS})"
_PERIODS = f"select * from ({_ONCE}) union all select * from ({_ONCE}) where minute(finish) = 30"
# Distinct valid periods with copies, bounds as comparable numbers, and how many rows of the key have begun before their end and ended by their start.
_MET = """
    p as (select user_id, start, finish, count(*) as n_rows, coalesce(epoch_us(start), -9000000000000000000) as s,
            coalesce(epoch_us(finish), 9000000000000000000) as f
        from raw where start is null or finish is null or finish > start group by all),
    met as (select a.user_id, a.start, a.finish, a.n_rows, cast(sum(b.n_rows) - 1 as bigint) as n_overlaps
        from p a join p b on a.user_id is not distinct from b.user_id and b.s < a.f and a.s < b.f group by all)"""

ORACLES = {
    "trailing_frames": f"""
        select event_id, user_id, lag(event_id) over w as previous, lag(event_id, 7) over w as seventh,
            cast(sum(cents) over (w rows between 7 preceding and 1 preceding) as bigint) as total,
            max(cents) over (w rows between 7 preceding and current row) as dearest
        from ({_EVENTS}) window w as (partition by user_id order by ts, event_id)""",
    "running_balances": f"""
        select event_id, cast(sum(amount) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as balance
        from (select *, {SIGNED} from ({_EVENTS}))""",
    "overlapping_periods": f"with raw as ({_PERIODS}), {_MET} select * from met",
    "merged_stretches": f"""
        with raw as ({_PERIODS}), {_MET},
        o as (select *, case when s > coalesce(max(f) over (partition by user_id order by s, f rows between unbounded preceding and 1 preceding), s - 1)
            then 1 else 0 end as opens from p),
        i as (select *, sum(opens) over (partition by user_id order by s, f rows unbounded preceding) as nth from o)
        select user_id, case when min(s) > -9000000000000000000 then min(start) end as start,
            case when max(f) < 9000000000000000000 then max(finish) end as finish, cast(sum(n_rows) as bigint) as n_rows
        from i group by user_id, nth""",
    "events_as_of": f"""
        with e as ({_EVENTS})
        select v.event_id, v.user_id, s.event_id as state_id, s.event_type as state_type
        from (select * from e where event_type = 'view') v asof left join (select * from e where {VERSIONS}) s on v.user_id = s.user_id and v.ts >= s.ts""",
    "orphans_at_time": f"""
        with e as ({_EVENTS})
        select v.event_id
        from (select * from e where event_type = 'view' and user_id is not null) v
        asof left join (select *, ts + interval 1 second * (cents * 3) as until from e where {VERSIONS}) s on v.user_id = s.user_id and v.ts >= s.ts
        where s.event_id is null or s.until <= v.ts""",
    "ordered_metrics": f"""
        with e as (select *, {SIGNED} from ({_EVENTS})), raw as ({_ONCE}), {_MET},
        g as (select ts - lag(ts) over (partition by user_id order by ts) as gap from e),
        c as (select ts - lag(ts) over (partition by user_id order by ts) as gap from e where event_type = 'click'),
        j as (select cents, avg(cents) over (partition by user_id order by ts, event_id rows between 4 preceding and 1 preceding) as mean from e),
        b as (select sum(amount) over (partition by user_id order by ts, event_id rows unbounded preceding) as balance from e)
        select 'gaps' as metric_id, count(*)::double as value from g where gap > interval 1 hour
        union all select 'gaps_of_clicks', count(*)::double from c where gap > interval 2 hours
        union all select 'jumps', count(*)::double from j where abs(cents - mean) > 800
        union all select 'overdrawn', count(*)::double from b where balance < 0
        union all select 'overlaps', coalesce(sum(n_rows), 0)::double from met where n_overlaps > 0
        union all select 'stateless', count(*)::double from e v asof left join (select * from e where {VERSIONS}) s
            on v.user_id = s.user_id and v.ts >= s.ts where s.event_id is null and v.user_id is not null""",
}
