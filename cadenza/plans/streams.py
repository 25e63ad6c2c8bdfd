"""Streaming jobs over the event files, run to completion and compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profiles import rounded
from ..session import scratch_path
from ..streaming import metrics as st
from . import binding as b
from .logs import KIND
from .registry import query


def event_stream(spark, sf):
    """Events of the folder as a stream; the time-zone free column becomes a timestamp."""
    e = spark.readStream.schema(b.SCHEMAS["events"]).parquet(f"{sf}/events*.parquet")
    kind = F.when(F.col("event_type") == "click", "like").when(F.col("event_type") == "purchase", "use").when(F.col("event_type") == "signup", "rating").when(
        F.col("event_type") == "error", "dislike")
    return e.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", F.col("value")).alias("latency"),
        kind.alias("kind"), (F.col("value") / 500).alias("score"))


def _run(spark, stream, mode):
    path = scratch_path(spark, "stream")
    st.run_to_table(stream, path, scratch_path(spark, "stream-state"), mode)
    return spark.read.parquet(path)


SAT = "case when event_type = 'view' then null when event_type in ('click', 'purchase') then 1.0 when event_type = 'signup' then value / 500 else 0.0 end"


@query("str1_tumbling_daily", f"""
    select strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'view') as n, round(avg(value) filter (event_type = 'view'), 6) as mean_latency, round(avg({SAT}), 6)::double as satisfaction
    from events group by 1""")
def str1(spark, sf):
    out = _run(spark, st.tumbling(event_stream(spark, sf)), "complete")
    return rounded(out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "mean_latency", "satisfaction"))


@query("str2_sliding_day", """
    with w as (select unnest(range(0, 24)) as k), e as (select date_trunc('hour', ts) - to_hours(k::int) as s, value from events, w where event_type = 'view')
    select strftime(s, '%Y-%m-%d %H') as start, count(*) as n, round(avg(value), 6) as mean_latency from e group by 1""")
def str2(spark, sf):
    out = _run(spark, st.sliding(event_stream(spark, sf).where("latency is not null")), "complete")
    return rounded(out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n", "mean_latency"))


@query("str3_duplicate_suppression", "select count(*) as n, count(distinct event_id) as n_ids, round(sum(value) filter (event_type = 'view'), 4) as latency from events")
def str3(spark, sf):
    """Every event is delivered twice and counted once."""
    e = event_stream(spark, sf)
    doubled = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    path, late = scratch_path(spark, "once"), scratch_path(spark, "late")
    st.without_replays(doubled, "event_id", path, late, scratch_path(spark, "stream-state"))
    out = spark.read.parquet(path, late)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"), F.round(F.sum("latency"), 4).alias("latency"))


@query("str4_decision_feedback_join", f"""
    with d as (select event_id as decision_id, user_id, ts from events where event_type = 'view'),
    f as (select event_id as feedback_id, user_id, ts, {KIND} as kind from events where event_type <> 'view')
    select decision_id, feedback_id, kind from f asof join d on f.user_id = d.user_id and f.ts >= d.ts""")
def str4(spark, sf):
    e = event_stream(spark, sf)
    is_decision = F.col("latency").isNotNull()
    log = e.select("user_id", "ts", F.when(is_decision, F.col("event_id")).alias("decision_id"), F.when(~is_decision, F.col("event_id")).alias("feedback_id"), "kind")
    return _run(spark, st.decisions_with_feedback(log), "append").where("decision_id is not null").select("decision_id", "feedback_id", "kind")
