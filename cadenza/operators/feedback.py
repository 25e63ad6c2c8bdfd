"""Decision and feedback logs: satisfaction, period metrics, version comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals
from .ordering import exact_quantiles


def worth(kind: Column, value: Column, narrow: bool = False) -> Column:
    """Satisfaction of one feedback; `narrow` counts only rating, like and dislike."""
    base = F.when(kind == "rating", value).when(kind == "like", 1.0).when(kind == "dislike", 0.0)
    return base if narrow else base.when(kind == "use", 1.0).when(kind == "skip", 0.2)


def attach(feedback: DataFrame, decisions: DataFrame, unit_of) -> DataFrame:
    """Feedback with the last decision of the same user at or before it."""
    points = decisions.select("user_id", "t", "decision_id", "version")
    found = intervals.last_and_first(feedback, points, ["user_id"], "t", unit_of, ["decision_id", "version"])
    return found.where("before is not null").withColumns(
        {"decision_id": F.col("before.decision_id"), "version": F.col("before.version")}).drop("before", "after")


def within(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Explicit period, closed at both ends."""
    return df.where(F.col(ts).between(start, end))


def period_metrics(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: volume, latency, score quartiles, distinct items, feedback counts, satisfaction."""
    scores = decisions.select(F.explode("scores").alias("score"))
    quartiles = exact_quantiles(scores, [], "score", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    s = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d"))
    items = decisions.select(F.explode("items").alias("i")).agg(F.count_distinct("i"))
    happy = worth(F.col("kind"), F.col("value"))
    f = feedback.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "like").alias("likes"), F.coalesce(F.avg(happy), F.lit(0.5)).alias("sat"))
    n = F.count(F.lit(1))
    out = decisions.agg(n.alias("n_decisions"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("mean_latency"))
    return out.select(
        "*", *[quartiles.select(q).scalar().alias(f"score_{q}") for q in ("q1", "median", "q3")],
        s.select("m").scalar().alias("score_mean"), s.select("d").scalar().alias("score_std"), items.scalar().alias("n_items"),
        f.select("n").scalar().alias("n_feedback"), f.select("likes").scalar().alias("n_likes"),
        F.when(F.col("n_decisions") == 0, 0.0).otherwise(f.select("sat").scalar()).alias("satisfaction"))


def by_version(decisions: DataFrame, attached: DataFrame) -> DataFrame:
    """Per version: sample size, latency, score, feedback count and satisfaction."""
    d = decisions.groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean_latency"),
        F.try_divide(F.sum(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)), F.sum(F.size("scores"))).alias("mean_score"))
    f = attached.groupBy("version").agg(
        F.count(F.lit(1)).alias("n_feedback"), F.coalesce(F.avg(worth(F.col("kind"), F.col("value"), narrow=True)), F.lit(0.5)).alias("satisfaction"))
    return d.join(f, "version", "left").fillna({"n_feedback": 0, "satisfaction": 0.5})


def daily(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every day between the first and last decision, half-open days, zeros where nothing happened."""
    d = decisions.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean_latency"))
    f = feedback.groupBy(F.to_date("ts").alias("day")).agg(F.avg(worth(F.col("kind"), F.col("value"))).alias("sat"))
    days = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    j = days.join(d, "day", "left").join(f, "day", "left")
    return j.select(
        "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_latency", F.lit(0.0)).alias("mean_latency"),
        F.when(F.col("n").isNull(), 0.0).otherwise(F.coalesce("sat", F.lit(0.5))).alias("satisfaction"))
