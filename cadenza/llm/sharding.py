"""Contiguous shards of equal size: global byte prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned by id, so partitions are contiguous in the order. Each partition sums its own rows; the totals
of the partitions, one row each, give every partition its offset; offset plus running sum is the global prefix sum. A row
goes to the shard in which the middle of its bytes falls. DataFrame functions only; texts are measured in the scan and
do not shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import staged

SHARDS = 16


def byte_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of `docs`.

    The order is by id, then checksum, then size; null ids come first; repeated rows each count. A null text has no bytes
    and a size of 1, like an empty one, but a null checksum counts as that of the empty text. A text longer than a shard's
    target gets the shard that holds its middle, and shards it covers stay empty. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = staged(
        sized.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()), "placed")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per partition: a few hundred kilobytes for ten thousand partitions.
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole).alias("all_bytes"))
    own = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        placed.withColumn("upto", F.sum("size").over(own)).withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(offsets), "part")
        .select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("place"),
                F.expr(f"int(least({shards - 1}, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * all_bytes)))").alias("shard"))
    )
    # At most one row per shard.
    firsts = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
