"""Streams in many batches: no row is lost, whatever the order of delivery."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadenza.plans import binding as b
from cadenza.session import scratch_path
from cadenza.streaming import metrics as st

SF = "/root/testdata/sf0.001"
COLUMNS = "event_id long, user_id long, ts timestamp, kind string"


def files(spark, df, order, n):
    """`n` files, dealt by `order`, and the stream that reads one of them in each batch."""
    path = scratch_path(spark, "in")
    parts = df.withColumn("part", F.ntile(n).over(Window.partitionBy(F.lit(0)).orderBy(order)))
    for k in range(1, n + 1):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("order", ["event_id", "ts"])
def test_every_row_once(spark, order):
    """Every event twice; by id the files are shuffled in time, and the second copies come batches later."""
    e = b.events(spark, SF).select("event_id", "user_id", "ts", F.col("event_type").alias("kind"))
    e = e.unionByName(spark.createDataFrame([(10**9, 1, None, "x")] * 2, COLUMNS))
    copies = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    by = F.xxhash64("event_id", "copy") if order == "event_id" else F.struct("copy", "ts", "event_id")
    path = files(spark, copies, by, 5)
    out, late = scratch_path(spark, "once"), scratch_path(spark, "late")
    st.without_replays(stream(spark, path, COLUMNS + ", copy int"), "event_id", out, late, scratch_path(spark, "state"))
    got, behind = spark.read.parquet(out), spark.read.parquet(late)
    ids = sorted(r[0] for r in got.select("event_id").collect() + behind.select("event_id").collect())
    assert ids == sorted({r[0] for r in e.select("event_id").collect()})
    assert behind.count() > (100 if order == "event_id" else 0)


def test_feedback_over_batches(spark):
    """In order of time, one file a batch, the links are those of the batch join; out of order, late feedback is marked and none is lost."""
    e = b.events(spark, SF)
    is_decision = F.col("event_type") == "view"
    log = e.select("user_id", "ts", F.when(is_decision, F.col("event_id")).alias("decision_id"), F.when(~is_decision, F.col("event_id")).alias("feedback_id"),
                   F.col("event_type").alias("kind"))
    want = {(r.feedback_id, r.decision_id) for r in entry.queries()["jon7_decision_feedback_join"](spark, SF).collect()}
    n_feedback = log.where("feedback_id is not null").count()
    for by, in_order in ((F.struct("ts", "feedback_id"), True), (F.xxhash64("feedback_id", "decision_id"), False)):
        path = files(spark, log, by, 3)
        out = scratch_path(spark, "linked")
        st.run_to_table(st.decisions_with_feedback(stream(spark, path, log.schema)), out, scratch_path(spark, "state"))
        rows = spark.read.parquet(out).collect()
        assert len(rows) == n_feedback
        linked = {(r.feedback_id, r.decision_id) for r in rows if r.decision_id is not None}
        if in_order:
            assert linked == want and not any(r.is_late for r in rows)
        else:
            assert any(r.is_late for r in rows) and not any(r.is_late and r.decision_id is not None for r in rows)
