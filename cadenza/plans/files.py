"""Readers and writers, each as a round trip of the tables through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, scores, text, vocab
from ..operators import profiles, timeline
from ..session import scratch_path
from ..sources import catalogue as cat
from ..sources import tables as tb
from . import binding as b
from .catalogue import BALANCE_SQL, CONSISTENT_SQL, ERRORS_SQL, balances, checked_items, consistency, songs
from .logs import decisions, feedback
from .registry import query
from .songs import detection_quality

QUALITY_SQL = """select 0.4 * least(1, rate / 0.8) + 0.4 * least(1, conf / 0.6) + 0.2 * greatest(0, 1 - low / 0.2) as score, rate < 0.8 or conf < 0.6 or low > 0.2 as bad
    from (select avg((y > 0.1)::int) as rate, avg(x) as conf, count(*) filter (x < 0.5) / count(*)::double as low from frames group by user_id)"""
SHARD = 500  # clips per catalogue document


def clips(spark, sf):
    """Items in the catalogue file format."""
    i = b.items(spark, sf)
    key = F.col("item_id")
    return i.select(
        F.concat(F.lit("clip_"), key.cast("string")).alias("clip_id"), F.concat(F.col("label"), F.lit("/"), key.cast("string"), F.lit(".mp4")).alias("video_path"),
        F.col("label").alias("move_label"), F.col("energy").alias("energy_level"), F.col("tempo").cast("int").alias("estimated_tempo"), "difficulty",
        F.col("role").alias("lead_follow_roles"), "notes", F.when(key % 3 > 0, F.col("duration")).alias("duration_seconds"), F.lit("good").alias("video_quality"),
        F.lit("good").alias("lighting_quality"), (key % 2 == 0).alias("full_body_visible"), F.when(key % 4 > 0, F.col("tempo_lo").cast("int")).alias("tempo_range_min"),
        F.when(key % 4 > 0, F.col("tempo_hi").cast("int")).alias("tempo_range_max"), F.array("label", F.lit("basic_step")).alias("compatible_moves"),
        F.when(key % 5 > 0, F.lit("ann")).alias("annotator"), F.lit(None).cast("string").alias("annotation_date"))


CLIP_SQL = dict(clips="""select 'clip_' || item_id as clip_id, label as move_label, tempo as estimated_tempo, notes, case when item_id % 3 > 0 then duration end as duration_seconds,
    case when item_id % 4 > 0 then tempo_lo::int end as tempo_range_min, item_id % 2 = 0 as full_body_visible, label || ',basic_step' as moves from items""")
CLIP_COUNTS = """select move_label, count(*) as n, sum(estimated_tempo)::bigint as tempo_sum, count({d}) as n_durations, count({r}) as n_ranges, count(*) filter ({v}) as n_visible,
    min({m}) as moves from clips group by 1"""


def _clip_counts(df):
    return df.groupBy("move_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_tempo").alias("tempo_sum"), F.count("duration_seconds").alias("n_durations"),
        F.count("tempo_range_min").alias("n_ranges"), F.count_if("full_body_visible").alias("n_visible"), F.min(F.array_join("compatible_moves", ",")).alias("moves"))


FULL_SQL = b.with_("items", **CLIP_SQL) + CLIP_COUNTS.format(d="duration_seconds", r="tempo_range_min", v="full_body_visible", m="moves")


def _shard(df_key="clip_id"):
    return F.floor(F.substring_index(F.col(df_key), "_", -1).cast("long") / SHARD)


@query("src1_catalogue_json_scan", FULL_SQL)
def src1(spark, sf):
    path = scratch_path(spark, "catalogue")
    cat.write_documents(clips(spark, sf), path, "rules", _shard(), full=True)
    return _clip_counts(cat.read_documents(spark, path))


@query("src2_csv_scan", FULL_SQL)
def src2(spark, sf):
    path = scratch_path(spark, "clips-csv")
    cat.write_csv(clips(spark, sf), path)
    good, _ = cat.read_csv(spark, path)
    return _clip_counts(good)


@query("src2_csv_rejects", b.with_("items") + "select count(*) filter (item_id % 10 = 0) as n_rejected, count(*) filter (item_id % 10 <> 0) as n_good from items")
def src2_rejects(spark, sf):
    """Every tenth row loses its tempo and is set aside."""
    path = scratch_path(spark, "clips-csv")
    key = F.substring_index("clip_id", "_", -1).cast("long")
    broken = clips(spark, sf).withColumn("move_label", F.when(key % 10 == 0, "NaN").otherwise(F.col("move_label")))
    cat.write_csv(broken, path)
    good, bad = cat.read_csv(spark, path)
    return bad.agg(F.count(F.lit(1)).alias("n_rejected")).withColumn("n_good", good.agg(F.count(F.lit(1))).scalar())


@query("src3_csv_sink", b.with_("items", **CLIP_SQL) + "select count(*) as n, count(distinct moves) as n_lists, max(len(string_split(moves, ',')))::int as longest, 17 as n_columns from clips")
def src3(spark, sf):
    path = scratch_path(spark, "clips-csv")
    cat.write_csv(clips(spark, sf), path)
    raw = spark.read.option("header", True).csv(path)
    return raw.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("compatible_moves").alias("n_lists"),
                   F.max(F.size(F.split("compatible_moves", ","))).alias("longest")).withColumn("n_columns", F.lit(len(raw.columns)))


@query("src4_json_sink_base_columns", b.with_("items", **CLIP_SQL) + CLIP_COUNTS.format(d="null::int", r="null::int", v="false", m="''"))
def src4(spark, sf):
    """The short form drops the optional columns."""
    path = scratch_path(spark, "catalogue")
    cat.write_documents(clips(spark, sf), path, "rules", _shard(), full=False)
    return _clip_counts(cat.read_documents(spark, path)).withColumn("moves", F.coalesce("moves", F.lit("")))


@query("src7_song_analysis_scan", b.with_(songs="select o_orderkey as song_id, 85 + o_totalprice / 7000 as tempo, (o_orderkey % 100) / 100.0 as rhythm, 1 + o_orderkey % 9 as sections from orders") + """
    select count(*) as n, round(avg(tempo), 6) as mean_tempo, round(avg(rhythm), 6) as mean_rhythm, sum(sections)::bigint as n_sections from songs""")
def src7(spark, sf):
    path = scratch_path(spark, "analysis")
    sec = F.transform(F.sequence(F.lit(1), F.col("sections")), lambda i: F.struct(
        ((i - 1) * 30.0).alias("start_time"), (i * 30.0).alias("end_time"), F.lit("verse").alias("section_type")))
    one = F.struct(
        F.concat(F.lit("song_"), F.col("song_id").cast("string")).alias("song_name"),
        F.struct((F.col("sections") * 30.0).alias("duration"), "tempo", (F.col("sections") * 60).alias("beats_detected"),
                 F.struct(F.col("rhythm").alias("pattern_strength"), F.col("sync").alias("syncopation_level")).alias("rhythm_features"),
                 F.struct(F.col("sections").alias("count"), sec.alias("sections")).alias("musical_sections")).alias("analysis_results"))
    docs = songs(spark, sf).groupBy(F.floor(F.col("song_id") / SHARD).alias("s")).agg(F.collect_list(one).alias("results")).select("results")
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)  # one document per file
    r = tb.read_analysis(spark, path)
    return profiles.rounded(r.agg(F.count(F.lit(1)).alias("n"), F.avg("tempo").alias("mean_tempo"), F.avg("rhythm").alias("mean_rhythm"), F.sum(F.size("sections")).alias("n_sections")))


@query("src8_event_log_scan", "select event_type, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first_day, round(sum(value), 4) as total from events group by 1")
def src8(spark, sf):
    """JSON events with ISO timestamps, written and scanned again."""
    path = scratch_path(spark, "events-json")
    b.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "event_type", "value").write.json(path)
    e = tb.read_json_log(spark, path, "event_id long, ts string, event_type string, value double")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.round(F.sum("value"), 4).alias("total"))


@query("src9_event_log_sink", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(*) filter (event_type = 'view') as n_views from events group by 1")
def src9(spark, sf):
    path = scratch_path(spark, "log")
    e = b.table(spark, sf, "events")
    views = F.col("event_type") == "view"
    tb.append_log(e.where(views), path)
    tb.append_log(e.where(~views), path)
    back = tb.read_log(spark, path, e.schema.add("dt", "date"))
    return back.groupBy(F.col("dt").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(views).alias("n_views"))


def metadata_rows(spark, sf):
    """Stored sequence metadata: one flat row per sequence with tags, types and source hash."""
    s = b.slots(spark, sf).groupBy("seq_id").agg(
        F.avg("tempo").alias("tempo"), F.sum("seconds").alias("duration"), F.sort_array(F.collect_set(labels.type_of(F.col("label")))).alias("move_types"),
        F.round(F.avg("similarity"), 9).alias("rhythm"),
        *[F.count_if(F.col("difficulty") == x).alias(f"n_{x}") for x in vocab.DIFFICULTIES]).withColumn("difficulty", timeline.majority_band())
    source = F.concat(F.lit("song_"), F.col("seq_id").cast("string"))
    tags = text.search_tags(F.col("tempo"), F.lit(0.2), F.col("rhythm"), F.lit(0.5), F.col("move_types"), F.lit("balanced"))
    return s.select(
        F.col("seq_id").cast("string").alias("sequence_id"), source.alias("source"), F.md5(source).alias("source_hash"),
        "tempo", "difficulty", "duration", tags.alias("tags"), "move_types")


META_SQL = dict(meta="""select seq_id::varchar as sequence_id, md5('song_' || seq_id) as source_hash, avg(tempo) as tempo, sum(seconds) as duration, round(avg(similarity), 9) as rhythm,
    case when count(*) filter (difficulty = 'beginner') >= greatest(count(*) filter (difficulty = 'intermediate'), count(*) filter (difficulty = 'advanced')) then 'beginner'
      when count(*) filter (difficulty = 'intermediate') >= count(*) filter (difficulty = 'advanced') then 'intermediate' else 'advanced' end as difficulty from slots group by seq_id""")


@query("src10_many_file_scan", b.with_("slots", **META_SQL) + "select difficulty, count(*) as n, round(avg(tempo), 6) as mean_tempo, count(*) filter (rhythm > 0.7) as n_strong from meta group by 1")
def src10(spark, sf):
    """Metadata files read back; a broken file in the same folder is skipped."""
    path = scratch_path(spark, "metadata")
    metadata_rows(spark, sf).write.json(path)
    b.table(spark, sf, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("append").text(path)
    m = tb.read_metadata(spark, path)
    return m.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("tempo"), 6).alias("mean_tempo"), F.count_if(F.array_contains("tags", "strong_rhythm")).alias("n_strong"))


def _bundle(spark, sf):
    return {
        "items": b.items(spark, sf).withColumn("item_id", F.when(F.col("item_id") % 10 > 0, F.col("item_id").cast("string"))),
        "vectors": b.vectors(spark, sf), "events": b.table(spark, sf, "events")}


@query("src11_bundle_export", "select 'items' as table_name, count(*) as n, false as has_vectors from part union all select 'vectors', count(*), false from embeddings union all select 'events', count(*), false from events")
def src11(spark, sf):
    """Export without vectors; rows per table read back from the written folders."""
    path = scratch_path(spark, "bundle")
    tables = _bundle(spark, sf)
    tb.export_bundle(tables, path, vectors=False)
    back = {n: spark.read.parquet(f"{path}/{n}") for n in tables}
    return tb.counts(back).withColumn("has_vectors", F.lit(any("vec" in df.columns for df in back.values())))


@query("src12_bundle_import", """select 'items' as table_name, count(*) as n, count(*) filter (p_partkey % 10 = 0) as n_default_ids from part
    union all select 'vectors', count(*), 0 from embeddings union all select 'events', count(*), 0 from events""")
def src12(spark, sf):
    path = scratch_path(spark, "bundle")
    tables = _bundle(spark, sf)
    tb.export_bundle(tables, path)
    back = tb.import_bundle(spark, path, {n: df.schema for n, df in tables.items()}, {"items": "item_id"})
    made = back["items"].agg(F.count_if(F.col("item_id").startswith("items-"))).scalar()
    return tb.counts(back).withColumn("n_default_ids", F.when(F.col("table_name") == "items", made).otherwise(F.lit(0).cast("long")))


@query("src13_vector_load", b.with_("vecs") + """select count(*) as n, 70::int as dim, round(sum(list_sum(vec)), 5) as total, (select count(*) from vecs where vec_id % 7 = 0) as n_skipped from vecs where vec_id % 7 <> 0""")
def src13(spark, sf):
    path = scratch_path(spark, "vectors")
    v = b.vectors(spark, sf).withColumn("vec", F.when(F.col("vec_id") % 7 != 0, F.col("vec")))
    tb.write_vectors(v, path, "vec", 70)
    back = spark.read.schema(v.schema).parquet(path)
    lost = v.agg(F.count_if(F.col("vec").isNull())).scalar()
    return back.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)), 5).alias("total")).withColumn("n_skipped", lost)


@query("src14_full_refresh", "select count(*) as n_total, count(*) as n_stored, 0::bigint as n_failed from embeddings")
def src14(spark, sf):
    """The second load replaces the first one; reloading the same keys adds nothing."""
    path = scratch_path(spark, "vectors")
    v = b.vectors(spark, sf)
    first = v.select((F.col("vec_id") + 10**6).alias("vec_id"), "vec", "vec_label").unionByName(v)
    tb.write_vectors(first, path, "vec", 64)
    fresh = v
    tb.write_vectors(fresh, path, "vec", 64)
    stored = spark.read.schema(v.schema).parquet(path).agg(F.count_distinct("vec_id")).scalar()
    return fresh.agg(F.count(F.lit(1)).alias("n_total")).select("n_total", stored.alias("n_stored")).withColumn("n_failed", F.col("n_total") - F.col("n_stored"))


@query("src16_sequence_export", b.with_("slots", r="select seq_id, pos, seconds, sum(seconds) over (partition by seq_id order by pos) as e from slots") + """
    select seq_id, count(*)::int as n_slots, max(e) as last_end, min(e - seconds) as first_start from r group by 1""")
def src16(spark, sf):
    """Nested record per sequence: info and ordered slots with their end time, written and read back."""
    from pyspark.sql import Window

    path = scratch_path(spark, "sequences")
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = b.slots(spark, sf).withColumn("end_time", F.sum("seconds").over(w)).withColumn("start_time", F.col("end_time") - F.col("seconds"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "item_id", "label", "start_time", F.col("seconds").alias("duration"), "end_time")))
    nested = s.groupBy("seq_id").agg(rows.alias("moves"), F.sum("seconds").alias("total"))
    out = nested.select(F.struct("seq_id", "total").alias("info"), "moves", F.to_json(F.struct(F.lit("balanced").alias("mode"))).alias("config"))
    out.write.json(path)
    m = spark.read.schema(out.schema).json(path)
    return m.select("info.seq_id", F.size("moves").alias("n_slots"), F.element_at("moves", -1)["end_time"].alias("last_end"), F.get("moves", 0)["start_time"].alias("first_start"))


@query("src17_metadata_append", b.with_("slots", **META_SQL) + "select sequence_id, source_hash, duration from meta")
def src17(spark, sf):
    path = scratch_path(spark, "store")
    rows = metadata_rows(spark, sf)
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select("sequence_id", "source_hash", "duration")


@query("src18_result_record", "select round(avg(o_totalprice), 4) as score, count(*) as n, min(o_orderstatus) as first_status from orders")
def src18(spark, sf):
    """A tuning record as nested JSON, reloaded equal."""
    path = scratch_path(spark, "result")
    rec = b.table(spark, sf, "orders").agg(
        F.struct(F.round(F.avg("o_totalprice"), 4).alias("score"), F.struct(F.count(F.lit(1)).alias("n"), F.min("o_orderstatus").alias("first_status")).alias("detail")).alias("result"))
    rec.write.json(path)
    return spark.read.schema(rec.schema).json(path).select("result.score", "result.detail.n", "result.detail.first_status")


@query("agg12_validation_rollup", b.with_("frames", "motion", **ERRORS_SQL, **CONSISTENT_SQL, q=QUALITY_SQL) + f"""
    select count(*) as n, count(*) filter (len(errors) > 0) as n_rule_issues, (select round(avg(score), 6) from q) as quality, (select count(*) from q where bad) as n_quality_issues,
      (select round(avg(score), 6) from consistent) as consistency, (select count(*) from consistent where mismatches <> '') as n_mismatches,
      round({BALANCE_SQL.format(src='items', col='label')}, 6) as label_balance from checked""")
def agg12(spark, sf):
    """Collection, detection quality, consistency and balance in one row."""
    c = checked_items(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("n_rule_issues"))
    q = detection_quality(b.frames(spark, sf)).agg(F.avg("score").alias("m"), F.count_if(F.col("issues") != "").alias("k"))
    s = consistency(spark, sf).agg(F.avg("score").alias("m"), F.count_if(F.col("mismatches") != "").alias("k"))
    bal = balances(b.items(spark, sf), ["label", "difficulty", "energy"])
    return profiles.rounded(c.select(
        "*", q.select("m").scalar().alias("quality"), q.select("k").scalar().alias("n_quality_issues"), s.select("m").scalar().alias("consistency"),
        s.select("k").scalar().alias("n_mismatches"), bal.select("label_balance").scalar().alias("label_balance")))
