"""Streams over several batches: order, lateness, restarts and forgetting."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isohyet.streaming import incremental as inc, periods

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = dt.datetime(2024, 3, 1, 12)


def arrive(spark, folder, rows):
    """One file, as (event_id, day, user, type, value)."""
    rows = [(i, None if d is None else DAY + dt.timedelta(days=d), u, t, v) for i, d, u, t, v in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, result):
    return inc.run_once(result(inc.event_stream(spark, f"{folder}/in", "*.parquet")), f"{folder}/out", f"{folder}/state")


def told(spark, folder):
    day = lambda s: (dt.datetime.fromtimestamp(s, dt.UTC).date() - DAY.date()).days
    with periods.state_in_files(spark):
        got = run(spark, folder, lambda s: periods.period_totals(s, "event_type", "value", 1, "1 hour", 2.0))
    return sorted((r["key"], day(r["period_end"]), r["state"], r["n"], r["total"]) for r in got.collect())


def test_periods_open_close_and_outlast_a_restart(spark, tmp_path):
    before = spark.conf.get(periods.PROVIDER)
    arrive(spark, tmp_path, [(1, 0, 1, "a", 1.0), (2, 0, 2, "a", 2.0), (3, 0, 1, "b", 5.0), (4, None, 1, "a", 9.0), (5, 0, 1, "a", None)])
    assert told(spark, tmp_path) == [("a", 1, "open", 2, 3.0), ("b", 1, "open", 1, 5.0)]
    # More of the same day after a restart: the state was kept.
    arrive(spark, tmp_path, [(6, 0.2, 1, "a", 4.0)])
    assert told(spark, tmp_path) == [("a", 1, "open", 2, 3.0), ("a", 1, "open", 3, 7.0), ("b", 1, "open", 1, 5.0)]
    # The next day closes both; a row of the first day is then too late.
    arrive(spark, tmp_path, [(7, 1.1, 1, "a", 8.0)])
    got = told(spark, tmp_path)
    assert ("a", 1, "closed", 3, 7.0) in got and ("b", 1, "closed", 1, 5.0) in got and ("a", 2, "open", 1, 8.0) in got
    arrive(spark, tmp_path, [(8, 0.1, 1, "a", 100.0)])
    assert told(spark, tmp_path) == got
    # A long silence: the period closes when it is no news any more.
    arrive(spark, tmp_path, [(9, 9, 1, "b", 1.0)])
    assert ("a", 2, "stale", 1, 8.0) in told(spark, tmp_path)
    assert [x for x in told(spark, tmp_path) if x[2] != "open" and x[:2] == ("a", 1)] == [("a", 1, "closed", 3, 7.0)]
    assert spark.conf.get(periods.PROVIDER) == before


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_one_event_a_key_in_the_order_of_arrival(spark, tmp_path, order):
    days = [[(10 * d + k, d, k, "x", 1.0) for k in range(3)] for d in range(3)]
    for d in order:
        arrive(spark, tmp_path, days[d])
        got = run(spark, tmp_path, lambda s: inc.notify_once(s, ["user_id"], "30 days"))
    assert sorted(r["event_id"] for r in got.collect()) == [10 * order[0] + k for k in range(3)]


def test_a_forgotten_key_is_told_of_again(spark, tmp_path):
    for k, d in enumerate((0, 5, 30, 60)):
        arrive(spark, tmp_path, [(k, d, 1 if k < 2 else k, "x", 1.0)] + ([(9, 30.01, 1, "x", 1.0)] if k == 3 else []))
        got = run(spark, tmp_path, lambda s: inc.notify_once(s, ["user_id"], "10 days"))
    assert sorted(r["event_id"] for r in got.select("event_id").collect())[:2] == [0, 2]


def test_keys_share_calls_and_are_forgotten_one_by_one(spark, tmp_path, monkeypatch):
    """Two groups of 100 keys: a call a group, not a key. A null key leaves the
    others the last digit, which floats do not have."""
    calls, big, grouped = spark.sparkContext.accumulator(0), 2**53 + 1, type(spark.range(1).groupBy("id"))
    plain = grouped.applyInPandasWithState

    def counted(self, f, *rest):
        def call(key, frames, state):
            calls.add(1)
            return f(key, frames, state)

        return plain(self, call, *rest)

    monkeypatch.setattr(grouped, "applyInPandasWithState", counted)
    batches = [
        [(k, 0, big + k, "x", 1.0) for k in range(200)] + [(big, 0, None, "x", 1.0), (big + 2, 0.1, None, "x", 1.0)],
        [(1000 + k, 8, big + k, "x", 1.0) for k in range(0, 200, 2)],
        [(2000, 24, 7, "x", 1.0)],
        [(4000 - 10 * d - k, 25 + d, big + k, "x", 1.0) for k in range(200) for d in (0, 1)],
    ]
    for rows in batches:
        arrive(spark, tmp_path, rows)
        got = run(spark, tmp_path, lambda s: inc.notify_once(s, ["user_id", "event_type"], "10 days", groups=2))
    # At day 14 the odd keys are forgotten, heard of at day 0, the even ones are not.
    again = [(4000 - k, big + k) for k in range(1, 200, 2)]
    assert sorted(((r.event_id, r.user_id) for r in got.collect()), key=str) == sorted([(k, big + k) for k in range(200)] + [(big, None), (2000, 7)] + again, key=str)
    assert calls.value <= 20


def test_targets_carry_over_batches(spark, tmp_path):
    for k, v in enumerate((10.0, 14.0, 16.0, 40.0)):
        arrive(spark, tmp_path, [(k, k, 1, "x", v)])
        got = run(spark, tmp_path, lambda s: inc.last_target(s, 5.0))
    assert [(r["target"], r["moved"]) for r in got.orderBy("event_id").collect()] == [(10.0, True), (10.0, False), (16.0, True), (40.0, True)]
    assert got.agg(F.count("*")).first()[0] == 4


def test_parts_of_a_restarted_stream_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from isohyet.plans import streams

    ts = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 6 * cast(id as int))")
    rows = spark.range(120).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "place", lambda spark: f"{tmp_path}/place")
    told = streams.restarted(spark, str(tmp_path), lambda s: inc.notify_once(s, ["user_id"], "60 days"))
    assert sorted(r.event_id for r in told.collect()) == [0, 1, 2]
    assert len(list((tmp_path / "place" / "in").glob("*.parquet"))) == 12


def test_targets_in_small_parts(spark, tmp_path):
    """Results of a batch are written in parts, and go on where the last ended."""
    values = [10.0, 14.0, 16.0, 40.0, 41.0, 30.0, 33.0]
    arrive(spark, tmp_path, [(k, k, 1, "x", v) for k, v in reversed(list(enumerate(values)))])
    got = run(spark, tmp_path, lambda s: inc.last_target(s, 5.0, write=3))
    assert [r["target"] for r in got.orderBy("event_id").collect()] == [10.0, 10.0, 16.0, 40.0, 40.0, 30.0, 30.0]
