"""Catalogue documents and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP_DDL = (
    "clip_id string, video_path string, move_label string, energy_level string, estimated_tempo int, "
    "difficulty string, lead_follow_roles string, notes string, duration_seconds double, video_quality string, "
    "lighting_quality string, full_body_visible boolean, tempo_range_min int, tempo_range_max int, "
    "compatible_moves array<string>, annotator string, annotation_date string"
)
DOCUMENT_DDL = f"instructions string, move_categories array<string>, clips array<struct<{CLIP_DDL.replace(' ', ':').replace(',:', ',')}>>"
REQUIRED = ["clip_id", "video_path", "move_label", "energy_level", "estimated_tempo", "difficulty", "lead_follow_roles", "notes"]
COLUMNS = [part.split()[0] for part in CLIP_DDL.split(", ")]
EMPTY_WORDS = ["", "nan", "none"]
TRUE_WORDS = ["true", "1", "yes"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Clips of every catalogue document below a path; a document is one task's work."""
    docs = spark.read.schema(DOCUMENT_DDL).option("multiLine", True).json(path)
    return docs.select(F.inline("clips"))


def read_documents_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The lenient loader: a missing path is an empty catalogue."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return read_documents(spark, path) if fs.exists(target) else spark.createDataFrame([], CLIP_DDL)


def write_documents(clips: DataFrame, path: str, instructions: str, shard: Column, full: bool = True) -> None:
    """One JSON document per shard of bounded size, with its category list.

    The short form keeps the eight required columns, the full form every one.
    """
    cols = COLUMNS if full else REQUIRED
    docs = clips.withColumn("_shard", shard).groupBy("_shard").agg(
        F.sort_array(F.collect_set("move_label")).alias("move_categories"),
        F.array_sort(F.collect_list(F.struct(*cols))).alias("clips"))
    docs.select(F.lit(instructions).alias("instructions"), "move_categories", "clips").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_csv(clips: DataFrame, path: str) -> None:
    """17 columns; the list is joined by commas and absent values stay blank."""
    flat = clips.withColumn("compatible_moves", F.array_join("compatible_moves", ","))
    flat.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS]).write.mode("overwrite").option(
        "header", True).option("emptyValue", "").csv(path)


def _text(c: str) -> Column:
    t = F.trim(F.col(c))
    return F.when(~F.lower(t).isin(EMPTY_WORDS), t)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows): cleaned and typed; a bad optional value is dropped, a bad required one rejects the row."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).option("header", True).csv(path)
    whole = lambda c: F.floor(_text(c).try_cast("double")).cast("int")
    typed = raw.select(
        *[_text(c).alias(c) for c in ("clip_id", "video_path", "move_label", "energy_level")],
        whole("estimated_tempo").alias("estimated_tempo"), _text("difficulty").alias("difficulty"), _text("lead_follow_roles").alias("lead_follow_roles"),
        F.coalesce(_text("notes"), F.lit("")).alias("notes"), _text("duration_seconds").try_cast("double").alias("duration_seconds"),
        F.coalesce(_text("video_quality"), F.lit("good")).alias("video_quality"), F.coalesce(_text("lighting_quality"), F.lit("good")).alias("lighting_quality"),
        F.coalesce(F.lower(_text("full_body_visible")).isin(TRUE_WORDS), F.lit(True)).alias("full_body_visible"),
        whole("tempo_range_min").alias("tempo_range_min"), whole("tempo_range_max").alias("tempo_range_max"),
        F.filter(F.transform(F.split(F.coalesce(_text("compatible_moves"), F.lit("")), ","), lambda m: F.trim(m)), lambda m: m != "").alias("compatible_moves"),
        _text("annotator").alias("annotator"), _text("annotation_date").alias("annotation_date"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    marked = typed.withColumn("missing", missing)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)
