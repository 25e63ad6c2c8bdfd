"""Structured Streaming forms of the decision metrics.

Each function takes streaming (or batch) frames with a `ts` timestamp column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.feedback import worth


def tumbling(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count, mean latency and satisfaction per window; decisions and feedback share the stream."""
    happy = worth(F.col("kind"), F.col("score"))
    return log.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(
        F.count("latency").alias("n"), F.avg("latency").alias("mean_latency"), F.avg(happy).alias("satisfaction"))


def sliding(log: DataFrame, late: str = "1 hour", width: str = "24 hours", step: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(
        F.count("latency").alias("n"), F.avg("latency").alias("mean_latency"))


def without_replays(log: DataFrame, key: str, path: str, late_path: str, checkpoint: str, horizon: str = "1 hour") -> None:
    """Every id once, whatever the order of delivery; processes everything available and stops.

    What has been seen is the table itself, by day of `ts`, so it outlives a restart and a repeated batch. A row not older than
    `horizon` before the newest row so far is on time and goes to `path`; for it only the days inside the horizon are
    read, the rest of the table has expired. An older row is late: it is compared with its own day and goes to the side
    table `late_path`. No row is dropped but copies of an id. A row without `ts` has no day of its own and is late.
    """
    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates([key]).withColumn("day", F.to_date("ts"))
        kinds = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}"
        for p in (path, late_path):  # an empty table of the same columns, on the first batch
            spark.createDataFrame([], kinds).write.mode("append").partitionBy("day").parquet(p)
        seen, late_seen = (spark.read.schema(kinds).parquet(p).select(key, "day", "ts") for p in (path, late_path))
        last_day = seen.agg(F.max("day")).first()[0]
        newest = seen.where(F.col("day") == F.lit(last_day)).agg(F.max("ts")).first()[0]
        edge = F.lit(newest).cast("timestamp") - F.expr(f"interval {horizon}")
        on_time = F.coalesce(F.col("ts") >= edge, F.col("ts").isNotNull() & F.lit(newest is None))
        fresh = rows.where(on_time)
        for known in (seen, late_seen):
            recent = known if newest is None else known.where(F.col("day") >= F.to_date(edge))
            fresh = fresh.join(recent.select(key), key, "left_anti")
        late = rows.where(~on_time)
        for known in (seen, late_seen):
            same = (late[key] == known[key]) & late["day"].eqNullSafe(known["day"])
            late = late.join(known, same, "left_anti")
        late.write.mode("append").partitionBy("day").parquet(late_path)
        fresh.write.mode("append").partitionBy("day").parquet(path)

    log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LAST = "decision_id long, ts timestamp"
LINK = "feedback_id long, kind string, decision_id long, is_late boolean"


def decisions_with_feedback(log: DataFrame) -> DataFrame:
    """Feedback with the last earlier decision of its user: keyed state, one decision for each user, no span.

    `log` has user_id, ts, decision_id (null for feedback), feedback_id (null for decisions) and kind. Inside a batch rows
    are taken by time, decisions first. Feedback older than the decision in the state came late: it is given with `is_late`
    and no decision, for a batch join (`operators.feedback.attach`) to settle. Feedback before any decision is given likewise,
    not late.
    """
    def link(key, parts, state):
        held = state.get if state.exists else None
        rows = pd.concat(list(parts), ignore_index=True)
        rows["after"] = rows.decision_id.isna()
        rows = rows.sort_values(["ts", "after", "decision_id", "feedback_id"], kind="stable")
        start = pd.Timestamp(held[1]) if held else None
        out = {"feedback_id": [], "kind": [], "decision_id": [], "is_late": []}
        for r in rows.itertuples(index=False):
            if not r.after:
                if held is None or r.ts >= pd.Timestamp(held[1]):
                    held = (int(r.decision_id), r.ts)
                continue
            late = start is not None and r.ts < start
            out["feedback_id"].append(int(r.feedback_id))
            out["kind"].append(r.kind)
            out["decision_id"].append(None if late or held is None else held[0])
            out["is_late"].append(late)
        if held is not None:
            state.update((held[0], pd.Timestamp(held[1]).to_pydatetime()))
        yield pd.DataFrame(out).astype({"feedback_id": "Int64", "decision_id": "Int64", "is_late": bool})

    return log.groupBy("user_id").applyInPandasWithState(link, LINK, LAST, "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; the sink is a parquet table."""
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        # Complete results are rewritten batch by batch.
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode("complete").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
