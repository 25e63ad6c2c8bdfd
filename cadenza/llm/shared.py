"""Written intermediates in the cluster's shared folder, and components of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later steps start from the files, also after executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables of `staged` that no later step reads: what came of them has been written."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Column of `numbered`.
ROW = "_row_of_stage"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for each row, written, so that each reading gives the same numbers."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; `links` has u and v, longs.

    Alternating large-star and small-star steps: each is one grouped minimum and one join, so a node with very many
    neighbours is pre-aggregated and its join rows may be split. Rounds grow with the logarithm of a component's size.
    Null ends and self-links are ignored; repeated links count once; an empty table gives an empty table.
    """
    edges = staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, staged(small, "edges")
        released(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
