"""Decision and feedback analytics on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators.ordering import running_totals
from ..operators.profiles import rounded, spread
from . import binding as b
from .registry import query

KIND = "case event_type when 'click' then 'like' when 'purchase' then 'use' when 'signup' then 'rating' else 'dislike' end"
LOG = dict(dec="select event_id as decision_id, ts, t, user_id, value as latency, user_id % 2 as version, [event_id % 97, event_id % 89] as items, [value / 500, value / 1000] as scores from ev where event_type = 'view'",
    fbk=f"select event_id as feedback_id, ts, t, user_id, {KIND} as kind, value / 500 as value from ev where event_type <> 'view'",
    att="""select f.*, d.decision_id, d.version from fbk f asof join dec d on f.user_id = d.user_id and f.t >= d.t""")
SAT = "case kind when 'rating' then value when 'like' then 1.0 when 'use' then 1.0 when 'dislike' then 0.0 when 'skip' then 0.2 end"
SAT3 = "case kind when 'rating' then value when 'like' then 1.0 when 'dislike' then 0.0 end"


def decisions(spark, sf):
    e = b.events(spark, sf).where("event_type = 'view'")
    return e.select(
        F.col("event_id").alias("decision_id"), "ts", "t", "user_id", F.col("value").alias("latency"), (F.col("user_id") % 2).alias("version"),
        F.array(F.col("event_id") % 97, F.col("event_id") % 89).alias("items"), F.array(F.col("value") / 500, F.col("value") / 1000).alias("scores"))


def feedback(spark, sf):
    kind = F.when(F.col("event_type") == "click", "like").when(F.col("event_type") == "purchase", "use").when(
        F.col("event_type") == "signup", "rating").otherwise("dislike")
    return b.events(spark, sf).where("event_type <> 'view'").select(
        F.col("event_id").alias("feedback_id"), "ts", "t", "user_id", kind.alias("kind"), (F.col("value") / 500).alias("value"))


def attached(spark, sf):
    return fb.attach(feedback(spark, sf), decisions(spark, sf), b.day_of)


@query("jon7_decision_feedback_join", b.with_("ev", **LOG) + "select feedback_id, decision_id, version, kind from att")
def jon7(spark, sf):
    return attached(spark, sf).select("feedback_id", "decision_id", "version", "kind")


@query("flt9_period_filter", b.with_("ev", **LOG) + """select decision_id, user_id from dec
    where ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-11 00:00:00'""")
def flt9(spark, sf):
    return fb.within(decisions(spark, sf), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-11 00:00:00").cast("timestamp")).select("decision_id", "user_id")


@query("agg16_period_metrics", b.with_("ev", **LOG, sc="select unnest(scores) as s from dec") + f"""
    select count(*) as n_decisions, round(avg(latency), 6) as mean_latency, (select round(quantile_cont(s, 0.25), 6) from sc) as score_q1, (select round(quantile_cont(s, 0.5), 6) from sc) as score_median,
      (select round(quantile_cont(s, 0.75), 6) from sc) as score_q3, (select round(avg(s), 6) from sc) as score_mean, (select round(stddev_pop(s), 6) from sc) as score_std,
      (select count(distinct i) from (select unnest(items) as i from dec)) as n_items, (select count(*) from fbk) as n_feedback, (select count(*) from fbk where kind = 'like') as n_likes,
      (select round(avg({SAT}), 6)::double from fbk) as satisfaction from dec""")
def agg16(spark, sf):
    return rounded(fb.period_metrics(decisions(spark, sf), feedback(spark, sf)))


@query("agg17_version_comparison", b.with_("ev", **LOG) + f"""
    select d.version, d.n, mean_latency, mean_score, n_feedback, satisfaction from
      (select version, count(*) as n, round(avg(latency), 6) as mean_latency, round(avg((scores[1] + scores[2]) / 2), 6) as mean_score from dec group by 1) d
      left join (select version, count(*) as n_feedback, round(avg({SAT3}), 6)::double as satisfaction from att group by 1) f using (version)""")
def agg17(spark, sf):
    return rounded(fb.by_version(decisions(spark, sf), attached(spark, sf)))


@query("agg18_daily_series", b.with_("ev", **LOG) + f"""
    select strftime(day, '%Y-%m-%d') as day, coalesce(n, 0) as n, round(coalesce(ml, 0), 6) as mean_latency, round(case when n is null then 0 else coalesce(sat, 0.5) end, 6)::double as satisfaction
    from (select unnest(generate_series((select min(ts)::date from dec), (select max(ts)::date from dec), interval 1 day))::date as day)
      left join (select ts::date as day, count(*) as n, avg(latency) as ml from dec group by 1) using (day)
      left join (select ts::date as day, avg({SAT}) as sat from fbk group by 1) using (day)""")
def agg18(spark, sf):
    return rounded(fb.daily(decisions(spark, sf), feedback(spark, sf)).withColumn("day", F.col("day").cast("string")))


@query("agg18_top_items", b.with_("ev", **LOG) + "select item, count(*) as n from (select unnest(items) as item from dec) group by item order by n desc, item limit 10")
def agg18_items(spark, sf):
    return decisions(spark, sf).select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(10)


@query("agg18_feedback_trends", b.with_("ev", **LOG) + "select strftime(ts, '%Y-%m-%d') as day, kind, count(*) as n from fbk group by 1, 2")
def agg18_trends(spark, sf):
    return feedback(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("agg26_benchmark_summary", """
    select event_type as operation, count(*) as n, round(avg(value / 1000), 6) as mean, round(stddev_pop(value / 1000), 6) as std, round(min(value / 1000), 6) as min, round(max(value / 1000), 6) as max,
      round(count(*) / sum(value / 1000), 6) as throughput, round(avg((value < 400)::int), 6) as success_rate from events group by 1""")
def agg26(spark, sf):
    sec = F.col("value") / 1000
    return rounded(b.table(spark, sf, "events").groupBy(F.col("event_type").alias("operation")).agg(
        F.count(F.lit(1)).alias("n"), *spread(sec), (F.count(F.lit(1)) / F.sum(sec)).alias("throughput"),
        F.avg((F.col("value") < 400).cast("int")).alias("success_rate")))


@query("agg30_search_path_comparison", """
    select round(count(*) filter (p = 0) / count(*)::double, 6) as share_a, round(a, 6) as mean_a, round(c, 6) as mean_b, round(c / a, 6) as speed_up, case when a <= c then 'a' else 'b' end as faster,
      round(count(*) filter (hit) / count(*)::double, 6) as hit_rate
    from (select user_id % 2 as p, value < 250 as hit, avg(value) filter (user_id % 2 = 0) over () as a, avg(value) filter (user_id % 2 = 1) over () as c from events where event_type = 'view') group by a, c""")
def agg30(spark, sf):
    e = b.table(spark, sf, "events").where("event_type = 'view'")
    first = F.col("user_id") % 2 == 0
    n = F.count(F.lit(1))
    m = e.agg(
        (F.count_if(first) / n).alias("share_a"), F.avg(F.when(first, F.col("value"))).alias("mean_a"), F.avg(F.when(~first, F.col("value"))).alias("mean_b"),
        (F.count_if(F.col("value") < 250) / n).alias("hit_rate"))
    return rounded(m.select(
        "*", F.try_divide(F.col("mean_b"), F.col("mean_a")).alias("speed_up"), F.when(F.col("mean_a") <= F.col("mean_b"), "a").otherwise("b").alias("faster")))


@query("win29_running_mean", b.with_("ev") + """
    select event_id, round(avg(value / 487.0) over (order by ts, event_id rows unbounded preceding), 6) as running from ev where event_type = 'view'""")
def win29(spark, sf):
    """Running mean over the whole log; totals are carried between hours."""
    e = b.events(spark, sf).where("event_type = 'view'").select("event_id", "ts", "t", "value")
    r = running_totals(e, [], ["ts", "event_id"], F.floor(F.col("t") / 3600), {"_sum": F.col("value") / 487.0, "_n": F.lit(1)})
    return r.select("event_id", F.round(F.col("_sum") / F.col("_n"), 6).alias("running"))


@query("win30_keep_last", "select event_id, value from events order by ts desc, event_id desc limit 1000")
def win30(spark, sf):
    return b.table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "value")
