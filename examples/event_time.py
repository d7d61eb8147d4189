"""Streams of events that land out of order: windows of event time, sessions, and what never came."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from dqspark import Metric
from dqspark.sources.readers import work_folder
from dqspark.streaming import Windows, advance_overdue, advance_windows
from examples.tables import table

# Each feed lands after the one before it; a fifth of the events come up to eleven days after their time.
FEEDS = 3
FEED = ("cast(least(floor((day(ts) - 1 + case when event_id * 7919 % 5 = 0 then event_id % 12 else 0 end) / 10), 2) as int)")

METRICS = [
    Metric("row_count", id="rows"), Metric("sum", id="total", column="event_id"), Metric("max", id="most", column="value"),
    Metric("count_where", id="errors", filter="event_type = 'error'"),
]


def _events(spark, sf):
    events = table(spark, sf, "events").withColumn("feed", F.expr(FEED))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _windows(spark, sf, windows, delay, keys=()):
    """Three feeds, each taken in by a call of its own, as by sessions that start anew."""
    events = _events(spark, sf)
    landing, sink = work_folder(spark, "events"), work_folder(spark, "event-windows")
    for feed in range(FEEDS):
        events.where(F.col("feed") == feed).repartition(4).write.mode("append").parquet(landing)
        advance_windows(spark, landing, METRICS, windows, sink, schema=events.schema, time="ts", keys=keys, delay=delay)
    return spark.read.parquet(f"{sink}/windows"), spark.read.parquet(f"{sink}/arrivals")


def _rows(found, *keys):
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "metric_id",
                        F.round("value", 6).alias("value"))


def stream_windows(spark, sf):
    """Windows of six hours by type, closed two days after the latest event; what came later is counted apart."""
    found, arrivals = _windows(spark, sf, Windows("6 hours"), "2 days", ["event_type"])
    counts = [arrivals.select(F.lit(None).cast("string").alias("window_start"), F.concat(F.lit("batch "), F.row_number().over(
        _order("batch_id"))).alias("event_type"), F.lit(name).alias("metric_id"), F.col(name).cast("double").alias("value")) for name in ("accepted", "late")]
    return _rows(found, "event_type").unionByName(counts[0]).unionByName(counts[1])


def _order(column):
    return Window.partitionBy(F.lit(0)).orderBy(column)  # one row a batch


def stream_sliding(spark, sf):
    """Windows of a day that begin every six hours."""
    return _rows(_windows(spark, sf, Windows("1 day", "6 hours"), "2 days")[0])


def stream_sessions(spark, sf):
    """Sessions of a user, which end after twelve hours without an event."""
    return _rows(_windows(spark, sf, Windows(gap="12 hours"), "12 days", ["user_id"])[0], "user_id")


def stream_overdue(spark, sf):
    """Clicks as expected files, purchases of the same user as arrivals: which come within six hours, and which never."""
    events = _events(spark, sf)
    due = events.where("event_type = 'click'").selectExpr("event_id", "user_id", "ts as due", "feed")
    came = events.where("event_type = 'purchase'").selectExpr("user_id", "ts as at", "feed")
    paths = [work_folder(spark, p) for p in ("expected", "arrived", "overdue")]
    for feed in range(FEEDS):
        for side, path in ((due, paths[0]), (came, paths[1])):
            side.where(F.col("feed") == feed).repartition(4).write.mode("append").parquet(path)
        advance_overdue(spark, *paths, expected_schema=due.schema, arrived_schema=came.schema, key=["user_id"], due="due", at="at",
                        within="6 hours", delay="12 days")
    return spark.read.parquet(f"{paths[2]}/files").select("event_id", F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss").alias("arrived_at"))


QUERIES = {"stream_windows": stream_windows, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_overdue": stream_overdue}

_E = f"""e as (select *, {FEED.replace('day(ts)', 'dayofmonth(ts)')} as feed from events),
    c as (select f.feed, max(e.ts) as clock from (select distinct feed from e) f left join e on e.feed < f.feed group by f.feed)"""
_MEASURES = """list_value({'m': 'rows', 'v': count(*)::double}, {'m': 'total', 'v': sum(event_id)::double}, {'m': 'most', 'v': max(value)},
            {'m': 'errors', 'v': (count(*) filter (event_type = 'error'))::double})"""
_START = "strftime(window_start, '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "stream_windows": f"""
        with {_E},
        w as (select e.*, clock, time_bucket(interval '6 hours', ts) as window_start from e join c using (feed)),
        f as (select *, clock is not null and window_start + interval '6 hours' <= clock - interval '2 days' as late from w),
        g as (select window_start, event_type, unnest({_MEASURES}) as x from f where not late group by window_start, event_type)
        select {_START} as window_start, event_type, x.m as metric_id, round(x.v, 6) as value from g
        where window_start + interval '6 hours' <= (select max(ts) from events) - interval '2 days'
        union all select null, 'batch ' || (feed + 1), 'accepted', (count(*) filter (not late))::double from f group by feed
        union all select null, 'batch ' || (feed + 1), 'late', (count(*) filter (late))::double from f group by feed""",
    "stream_sliding": f"""
        with {_E},
        w as (
            select e.*, clock, time_bucket(interval '6 hours', ts) - k * interval '6 hours' as window_start
            from e join c using (feed), (select unnest(range(4)) as k)),
        g as (
            select window_start, unnest({_MEASURES}) as x from w
            where clock is null or window_start + interval '1 day' > clock - interval '2 days' group by window_start)
        select {_START} as window_start, x.m as metric_id, round(x.v, 6) as value from g
        where window_start + interval '1 day' <= (select max(ts) from events) - interval '2 days'""",
    "stream_sessions": f"""
        with b as (
            select *, case when ts < lag(ts) over p + interval '12 hours' then 0 else 1 end as first
            from events window p as (partition by user_id order by ts, event_id)),
        s as (select *, sum(first) over (partition by user_id order by ts, event_id) as nth from b),
        g as (
            select user_id, min(ts) as window_start, max(ts) + interval '12 hours' as over, unnest({_MEASURES}) as x
            from s group by user_id, nth)
        select {_START} as window_start, user_id, x.m as metric_id, round(x.v, 6) as value from g
        where over <= (select max(ts) from events) - interval '12 days'""",
    "stream_overdue": """
        with d as (select event_id, user_id, ts as due from events where event_type = 'click'),
        a as (select user_id, ts as came from events where event_type = 'purchase'),
        j as (select event_id, due, came from d left join a on a.user_id = d.user_id and came >= due and came <= due + interval '6 hours'),
        w as (select least((select max(due) from d), (select max(came) from a)) - interval '12 days' as passed)
        select event_id, strftime(came, '%Y-%m-%d %H:%M:%S') as arrived_at from j, w where came is not null or due + interval '6 hours' < passed""",
}
