"""Vector tables, analysis documents, logs, sequence metadata and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import pad_to

ANALYSIS_DDL = (
    "results array<struct<song_name:string, analysis_results:struct<duration:double, tempo:double, beats_detected:long, "
    "rhythm_features:struct<pattern_strength:double, syncopation_level:double>, energy_profile:array<double>, "
    "audio_embedding:struct<dimensions:long, non_zero_count:long>, "
    "musical_sections:struct<count:long, sections:array<struct<start_time:double, end_time:double, section_type:string>>>>>>"
)
METADATA_DDL = "sequence_id string, source string, source_hash string, tempo double, difficulty string, duration double, tags array<string>, move_types array<string>, _corrupt string"


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """One row per analysed song with its sections as an array."""
    docs = spark.read.schema(ANALYSIS_DDL).option("multiLine", True).json(path)
    r = docs.select(F.inline("results"))
    a = "analysis_results"
    return r.select(
        "song_name", f"{a}.duration", f"{a}.tempo", f"{a}.beats_detected", F.col(f"{a}.rhythm_features.pattern_strength").alias("rhythm"),
        F.col(f"{a}.rhythm_features.syncopation_level").alias("sync"), F.col(f"{a}.musical_sections.sections").alias("sections"))


def append_log(df: DataFrame, path: str) -> None:
    """Events appended to a table partitioned by day."""
    df.withColumn("dt", F.to_date("ts")).repartition("dt", F.pmod(F.hash(*df.columns[:1]), F.lit(16))).write.mode("append").partitionBy("dt").parquet(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_json_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON events with ISO timestamps as text."""
    return spark.read.schema(ddl).json(path).withColumn("ts", F.to_timestamp("ts"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Many small JSON files; unreadable ones are skipped."""
    df = spark.read.schema(METADATA_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where(F.col("_corrupt").isNull() & F.col("sequence_id").isNotNull()).drop("_corrupt")


def write_vectors(df: DataFrame, path: str, vec: str, dim: int) -> None:
    """Full refresh: rows without a vector are left out, the rest padded or cut to `dim`."""
    df.where(F.col(vec).isNotNull()).withColumn(vec, pad_to(F.col(vec), dim)).write.mode("overwrite").parquet(path)


def export_bundle(tables: dict[str, DataFrame], path: str, vectors: bool = True, vector_columns=("vec",)) -> None:
    """One folder per table; vector columns are optional."""
    for name, df in tables.items():
        kept = df if vectors else df.drop(*vector_columns)
        kept.write.mode("overwrite").parquet(f"{path}/{name}")


def import_bundle(spark: SparkSession, path: str, schemas: dict, ids: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a bundle; a missing id gets a default from the row's content."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        key = ids.get(name)
        if key:
            default = F.concat(F.lit(f"{name}-"), F.md5(F.to_json(F.struct("*"))))
            df = df.withColumn(key, F.coalesce(F.col(key).cast("string"), default))
        out[name] = df
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)
