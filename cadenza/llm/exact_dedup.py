"""Exact deduplication by two-pass Bloom filtering.

Pass one reads each text once, writes its digest, and counts digests in a Bloom filter of fixed size whose cells are
summed over all tasks. Pass two asks the filter which digests may occur twice. Only those rows shuffle, grouped by digest;
every other row is known to be alone and passes straight through, without a shuffle. A full filter costs time, not
results: rows that it flags without need form groups of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.cells import CUT, cut, has_bits, repeated_bits
from cadenza.llm.shared import staged

#: Cells of the filter; its bits (2 MB) are broadcast. Double it for every 10 million rows beyond 10 million.
FILTER_CELLS = 1 << 24


def normalised(text: str) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _places(batch: pa.RecordBatch, cells: int) -> tuple[np.ndarray, np.ndarray]:
    digest = np.frombuffer(b"".join(x.as_py() for x in batch["digest"]), dtype=np.uint64).reshape(-1, 4)
    return tuple((digest[:, k] % np.uint64(cells)).astype(np.int64) for k in (0, 1))


def _count(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.int32)
        for batch in batches:
            if len(batch["digest"]):
                for places in _places(batch, cells):
                    at, times = np.unique(places, return_counts=True)
                    table[at] += times.astype(np.int32)
        yield from cut(table)
    return run


def _flag(filter_, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch["digest"]):
                continue
            first, second = _places(batch, cells)
            maybe = has_bits(filter_.value, first) & has_bits(filter_.value, second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=["doc_id", "digest", "maybe"])
    return run


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cells: int = FILTER_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal after white space is made single; null counts as empty, so all null, empty texts are one group. The
    row with the smallest id is kept; of rows that share that id too, exactly one. A null id comes after all others; a
    group of null ids only has a null keep_id and keeps one row. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"))
    rows = staged(rows, "digests")
    bits = spark.sparkContext.broadcast(repeated_bits(rows.select("digest").mapInArrow(_count(cells), CUT), cells))
    flagged = rows.mapInArrow(_flag(bits, cells), "doc_id long, digest binary, maybe boolean")
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    maybe = flagged.where("maybe").select("doc_id", "digest")
    groups = maybe.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = maybe.join(groups, "digest")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = Window.partitionBy("digest").orderBy("doc_id")
    kept = met.where(first).withColumn("kept", F.row_number().over(one) == 1).select("doc_id", "keep_id", "group_size", "kept", digest)
    rest = met.where(~first).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), digest)
    return alone.unionByName(kept).unionByName(rest)


def one_per_text(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept. Rows are named by their id: repeated ids with one text leave one row; of rows
    with a null id and one text, one stays if no row with an id has that text. Columns as before."""
    names = docs.columns
    marked = docs.withColumn("_digest", F.sha2(normalised("text").cast("binary"), 256))
    groups = exact_groups(docs).where("group_size > 1")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    kept = groups.where("kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    tied = gone.join(kept.withColumnsRenamed({"_gone": "_k", "_sha": "_s"}), (F.col("_sha") == F.col("_s")) & F.col("_gone").eqNullSafe(F.col("_k"))).select("_gone", "_sha")
    lost = gone.join(tied.withColumnsRenamed({"_gone": "_k", "_sha": "_s"}), (F.col("_sha") == F.col("_s")) & F.col("_gone").eqNullSafe(F.col("_k")), "left_anti")
    same = (F.col("doc_id").eqNullSafe(F.col("_gone"))) & (F.col("_digest") == F.col("_sha"))
    left = marked.join(lost, same, "left_anti")
    twice = left.join(tied, same, "left_semi").dropDuplicates(["doc_id", "_digest"])
    return left.join(tied, same, "left_anti").unionByName(twice).select(*names)
