"""Streaming queries, run over the events that are there and then stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable, shared_root
from ..streaming import incremental as inc, periods
from .base import query, r, table


def place(spark: SparkSession) -> str:
    """A new folder in the shared one (spark.checkpoint.dir)."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def finished(spark: SparkSession, result: DataFrame) -> DataFrame:
    p = place(spark)
    return inc.run_once(result, f"{p}/out", f"{p}/state")


def restarted(spark: SparkSession, sf_dir: str, result) -> DataFrame:
    """``result`` (a function of the stream) over four parts in the order of time, a
    batch each, stopped after each of them and started again: what is kept from
    batch to batch is state, and what outlasts the stop is the checkpoint."""
    p, e = place(reachable(spark)), table(spark, sf_dir, "events")
    ends = [F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz") for d in (8, 16, 24)]
    for k in range(4):
        part = e.where((F.col("ts") >= ends[k - 1] if k else F.lit(True)) & (F.col("ts") < ends[k] if k < 3 else F.lit(True)))
        part.write.mode("append").parquet(f"{p}/in")
        told = inc.run_once(result(inc.event_stream(spark, f"{p}/in", "*.parquet", None)), f"{p}/out", f"{p}/state")
    return told


@query("""with w as (select date_trunc('day', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2) select * from w where start + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are closed: an hour past their end by event time."""
    out = inc.tumbling(inc.event_stream(reachable(spark), sf_dir), "1 day", "1 hour")
    return finished(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("mean").alias("mean"))


@query("""select user_id, event_type, min(struct_pack(ts := ts, event_id := event_id)).event_id as event_id, min(ts) as ts from events group by 1, 2""")
def stream_dedup_notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event of each key was told of, and when it was. A key is remembered
    for longer than the events last."""
    told = restarted(spark, sf_dir, lambda stream: inc.notify_once(stream, ["user_id", "event_type"], "60 days"))
    return told.select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""with x as (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as start from events) select start, event_type, count(*) as n from x where start + interval 2 day <= (select max(ts) from events) - interval 1 hour group by 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days, one a day, that are closed."""
    out = inc.sliding(inc.event_stream(reachable(spark), sf_dir), "2 days", "1 day", "1 hour")
    return finished(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with e as (select event_type, list(event_id order by ts, event_id) as ids, list_reduce(list([value] order by ts, event_id), lambda a, x: list_append(a, case when abs(x[1] - a[len(a)]) >= 20 then x[1] else a[len(a)] end)) as targets from events group by 1),
x as (select event_type, unnest(ids) as event_id, unnest(targets) as target, unnest(range(1, len(ids) + 1)) as i from e)
select event_type, event_id, target, i = 1 or target <> lag(target) over (partition by event_type order by i) as moved from x""")
def stream_state_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets carried from batch to batch and over a restart."""
    return restarted(spark, sf_dir, lambda stream: inc.last_target(stream, 20.0))


@query("""with s as (select user_id, ts, sum(case when ts - before <= interval 12 hour then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as sess from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events)),
g as (select user_id, sess, min(ts) as start, max(ts) as last, count(*) as n from s group by 1, 2) select user_id, start, n from g where last + interval 12 hour <= (select max(ts) from events) - interval 1 hour""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are closed by event time."""
    out = inc.user_sessions(inc.event_stream(reachable(spark), sf_dir), "12 hours", "1 hour")
    return finished(spark, out).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


#: Events arrive in five files of six days each; some of the first twelve days
#: come late, in a sixth.
ARRIVAL = "case when event_id % 40 = 0 and ts < timestamp '2024-01-13' then 5 else least(day(ts) - 1, 29) // 6 end"


@query(f"""with e as (select event_type, ts, value, {ARRIVAL} as file, (floor(epoch(ts) / 345600) + 1) * 345600 as period from events), w as (select file, max(max(epoch(ts))) over (order by file) - 3600 as mark from e group by 1),
p as (select event_type, period, count(*) as n, sum(value) as total, count(distinct file) as partials, (select min(mark) from w where mark >= period) as closing from e where file < 5 group by 1, 2)
select event_type, make_timestamp(cast(period as bigint) * 1000000) as period_end, n, round(total, 6) as total, partials, case when closing is null then 'open' when floor(closing) - period <= 2 * 86400 then 'closed' else 'stale' end as state from p""")
def stream_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of four days by type: how often each was told of while open, and
    what was told last. The files come one by one, the stream is stopped after the
    third and started again, and the late file finds its periods closed."""
    p = place(reachable(spark))
    e = table(spark, sf_dir, "events").withColumn("file", F.when((F.col("event_id") % 40 == 0) & (F.col("ts") < F.lit("2024-01-13").cast("timestamp_ntz")), 5).otherwise(F.floor(F.least(F.dayofmonth("ts") - 1, F.lit(29)) / 6)))

    def run(files: list[int]) -> DataFrame:
        for k in files:
            e.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{p}/in")
        stream = inc.event_stream(spark, f"{p}/in", "*.parquet")
        with periods.state_in_files(spark):
            return inc.run_once(periods.period_totals(stream, "event_type", "value", 4, "1 hour", 2.0), f"{p}/out", f"{p}/state")

    run([0, 1, 2])
    told = run([3, 4, 5])
    last = F.max(F.struct(F.col("state") != "open", "n", "total", "state"))
    g = told.groupBy(F.col("key").alias("event_type"), "period_end").agg(last.alias("x"), F.count_if(F.col("state") == "open").alias("partials"))
    return g.select("event_type", F.timestamp_seconds("period_end").cast("timestamp_ntz").alias("period_end"), "x.n", r("x.total").alias("total"), "partials", "x.state")
