"""Catalogue rules, filters, statistics and upkeep on the item and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, music, scores, text, vocab
from ..operators import profiles, upkeep
from ..operators.ordering import running_totals
from . import binding as b
from .registry import query

RANK = b.sql_rank


def _list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _first_sql(col, rules, other="null"):
    whens = " ".join(f"when contains(lower({col}), '{w}') then '{v}'" for w, v in rules)
    return f"case {whens} else {other} end"


def _any_sql(col, words):
    return "(" + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


# --- row rules ---------------------------------------------------------------------

RAW_SQL = dict(raw="""select item_id, label, energy, role, notes, price,
    case when item_id % 17 = 0 then 'expert' else difficulty end as difficulty,
    70 + (item_id + floor(price)::bigint) % 101 as tempo, (item_id % 25)::double as duration,
    tempo_lo, tempo_hi - (item_id % 13)::double as tempo_hi from items""")


def raw_items(spark, sf):
    """Items as annotated, before any rule is applied: some rows break the rules."""
    i = b.items(spark, sf)
    key = F.col("item_id")
    return i.select(
        "item_id", "label", "energy", "role", "notes", "price",
        F.when(key % 17 == 0, "expert").otherwise(F.col("difficulty")).alias("difficulty"),
        (70 + (key + F.floor("price")) % 101).alias("tempo"),
        (key % 25).cast("double").alias("duration"),
        "tempo_lo", (F.col("tempo_hi") - key % 13).alias("tempo_hi"),
    )


ERRORS_SQL = dict(**RAW_SQL, checked="""select *, [zz for zz in ([
      case when difficulty not in ('beginner','intermediate','advanced') then 'difficulty' end,
      case when tempo not between 80 and 160 then 'tempo' end,
      case when duration not between 3 and 20 then 'duration' end,
      case when tempo_hi < tempo_lo then 'tempo_range' end]) if zz is not null] as errors from raw""")


def checked_items(spark, sf):
    raw = raw_items(spark, sf)
    return raw.withColumn("errors", labels.schema_errors({c: F.col(c) for c in raw.columns}))


@query("prj1_row_schema_validation", b.with_("items", **ERRORS_SQL) + """
    select item_id, array_to_string(errors, ',') as errors, len(errors) = 0 as is_valid from checked""")
def prj1(spark, sf):
    return checked_items(spark, sf).select(
        "item_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("is_valid"))


@query("prj2_range_check", b.with_("items", **RAW_SQL) + """
    select item_id, tempo_hi >= tempo_lo as range_ordered, tempo between tempo_lo and tempo_hi as tempo_in_range from raw""")
def prj2(spark, sf):
    return raw_items(spark, sf).select(
        "item_id", (F.col("tempo_hi") >= F.col("tempo_lo")).alias("range_ordered"),
        F.col("tempo").between(F.col("tempo_lo"), F.col("tempo_hi")).alias("tempo_in_range"))


@query("prj3_category_from_label", b.with_("items") + f"""
    select item_id, label, coalesce({_first_sql('label', vocab.CATEGORY_RULES)}, 'none') as category,
      coalesce({_first_sql("notes", vocab.CATEGORY_RULES)}, 'none') as notes_category from items""")
def prj3(spark, sf):
    return b.items(spark, sf).select(
        "item_id", "label", F.coalesce(labels.category_of(F.col("label")), F.lit("none")).alias("category"),
        F.coalesce(labels.category_of(F.col("notes")), F.lit("none")).alias("notes_category"))


@query("prj4_type_from_label", b.with_("items") + f"""
    select item_id, {_first_sql('label', vocab.TYPE_RULES, "'other'")} as kind from items""")
def prj4(spark, sf):
    return b.items(spark, sf).select("item_id", labels.type_of(F.col("label")).alias("kind"))


@query("prj5_ordinal_encoding", b.with_("items", **RAW_SQL) + f"""
    select item_id, {RANK('difficulty')} as difficulty_rank, {RANK('energy')} as energy_rank from raw""")
def prj5(spark, sf):
    return raw_items(spark, sf).select(
        "item_id", scores.level_rank(F.col("difficulty")).alias("difficulty_rank"),
        scores.level_rank(F.col("energy")).alias("energy_rank"))


@query("prj6_description", b.with_("items") + """
    select item_id, difficulty || ' ' || energy || ' energy ' || replace(label, '_', ' ')
      || case when item_id % 4 = 0 then '' else ' - ' || notes end as description from items""")
def prj6(spark, sf):
    notes = F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("notes"))
    return b.items(spark, sf).select(
        "item_id", labels.describe(F.col("label"), F.col("energy"), F.col("difficulty"), notes).alias("description"))


@query("prj22_song_description", b.with_("requests") + f"""
    select req_id, energy || ' energy ' || difficulty || d as plain,
      case style when 'energetic' then 'dynamic and expressive' when 'smooth' then 'flowing and connected'
        when 'technical' then 'precise and complex' else 'well-rounded' end || ' ' || difficulty || ' ' || energy || ' energy' || d as styled
    from (select *, ' {vocab.GENRE} with ' || case when tempo < 110 then 'slow' when tempo > 130 then 'fast' else 'medium tempo' end
      || ' ' || case when 1500 + balance / 10 > 2000 then 'bright' else 'warm' end || ' sound and '
      || case when abs(balance) / 20000 > 0.1 then 'strong rhythm' else 'gentle rhythm' end as d from requests)""")
def prj22(spark, sf):
    args = (F.col("tempo"), 1500 + F.col("balance") / 10, F.abs("balance") / 20000, F.col("difficulty"), F.col("energy"))
    return b.requests(spark, sf).select(
        "req_id", text.song_description(*args).alias("plain"), text.song_description(*args, style=F.col("style")).alias("styled"))


def _level_sql(col, rules):
    return "case " + " ".join(f"when {_any_sql(col, w)} then '{v}'" for v, w in rules) + " end"


PARSE_SQL = f"""select {{id}}, coalesce({_level_sql('text', vocab.REQUEST_DIFFICULTY)}, 'song') as difficulty,
      coalesce({_level_sql('text', vocab.REQUEST_ENERGY)}, 'song') as energy,
      case when contains(lower(text), 'lead') and not contains(lower(text), 'follow') then 'lead_focus'
           when contains(lower(text), 'follow') and not contains(lower(text), 'lead') then 'follow_focus' else 'both' end as role,
      array_to_string([zz for zz in ([{', '.join(f"case when {_any_sql('text', w)} then '{n}' end" for n, w in vocab.REQUEST_TYPE_WORDS)}]) if zz is not null], ',') as types,
      coalesce(try_cast(nullif(regexp_extract(lower(text), '([0-9]+)\\s*bpm', 1), '') as double), 90.0 + {{song}} % 61) as tempo,
      coalesce({_level_sql('text', vocab.REQUEST_WEIGHT_WORDS)}, 'default') as preset from {{src}}"""


def _parsed(df, ids, song):
    p = text.parse_request(F.col("text"), 90.0 + F.col(song) % 61)
    return df.select(*ids, p.alias("p")).select(
        *ids, F.coalesce("p.difficulty", F.lit("song")).alias("difficulty"), F.coalesce("p.energy", F.lit("song")).alias("energy"),
        F.col("p.role").alias("role"), F.array_join("p.types", ",").alias("types"), F.col("p.tempo").alias("tempo"),
        F.coalesce("p.preset", F.lit("default")).alias("preset"))


@query("prj23_request_parsing_documents", PARSE_SQL.format(id="doc_id", song="doc_id", src="documents"))
def prj23_documents(spark, sf):
    return _parsed(b.table(spark, sf, "documents"), ["doc_id"], "doc_id")


@query("prj23_request_parsing_conversations", PARSE_SQL.format(id="conv_id, turn", song="conv_id", src="conversations"))
def prj23_conversations(spark, sf):
    return _parsed(b.table(spark, sf, "conversations"), ["conv_id", "turn"], "conv_id")


# Item notes carry the words of a request: role, level, tempo.
TALK_SQL = dict(talk="""select item_id, difficulty || ' ' || energy || ' energy ' || role || ' ' || label || ' at ' || tempo || ' bpm '
    || case item_id % 4 when 0 then 'rhythm' when 1 then 'speed' when 2 then 'flow' else '' end as text from items""")


@query("prj23_request_parsing_items", b.with_("items", **TALK_SQL) + PARSE_SQL.format(id="item_id", song="item_id", src="talk"))
def prj23_items(spark, sf):
    i = b.items(spark, sf)
    topic = F.element_at(F.array(*[F.lit(w) for w in ("rhythm", "speed", "flow", "")]), (F.col("item_id") % 4 + 1).cast("int"))
    said = F.concat_ws(" ", "difficulty", "energy", F.lit("energy"), "role", "label", F.lit("at"), F.col("tempo").cast("string"), F.lit("bpm"), topic)
    return _parsed(i.select("item_id", said.alias("text")), ["item_id"], "item_id")


@query("prj34_search_tags", b.with_("requests") + """
    select req_id, array_to_string([zz for zz in ([
      case when tempo < 100 then 'slow' when tempo > 140 then 'fast' else 'medium_tempo' end,
      case when balance / 20000 > 0.3 then 'high_energy' when balance / 20000 < 0.15 then 'low_energy' else 'medium_energy' end,
      difficulty, energy, 'quality_' || style,
      case when (req_id % 10) / 10.0 > 0.7 then 'strong_rhythm' end,
      case when (req_id % 9) / 9.0 > 0.6 then 'syncopated' end]) if zz is not null], ',') as tags from requests""")
def prj34(spark, sf):
    tags = text.search_tags(
        F.col("tempo"), F.col("balance") / 20000, F.col("req_id") % 10 / 10.0, F.col("req_id") % 9 / 9.0,
        F.array("difficulty", "energy"), F.col("style"))
    return b.requests(spark, sf).select("req_id", F.array_join(tags, ",").alias("tags"))


PREDICT_SQL = dict(predicted=f"""select *, case when direction = 0 and contains(label, 'cross') then 'cross_body_lead'
      when direction = 0 and (contains(label, 'forward') or contains(label, 'backward')) then 'forward_backward'
      when coverage * 4 > 0.7 and contains(label, 'combination') then 'combination'
      when coverage * 4 > 0.7 and contains(label, 'body_roll') then 'body_roll'
      when contains(label, 'turn') and contains(label, 'right') then 'lady_right_turn'
      when contains(label, 'turn') and contains(label, 'left') then 'lady_left_turn'
      when contains(label, 'basic') then 'basic_step' end as p_category,
    case when (coverage * 4 + (item_id % 10) / 10.0) / 2 < 0.3 then 'beginner'
      when (coverage * 4 + (item_id % 10) / 10.0) / 2 < 0.7 then 'intermediate' else 'advanced' end as p_difficulty,
    case when 0.6 * speed_start + 0.4 * coverage < 0.02 then 'low' when 0.6 * speed_start + 0.4 * coverage < 0.05 then 'medium' else 'high' end as p_energy,
    {_first_sql('label', vocab.CATEGORY_RULES)} as category from motion""")


def predicted_items(spark, sf):
    m = b.motion(b.item_vectors(spark, sf))
    heading = F.element_at(F.array(*[F.lit(d) for d in ("horizontal", "horizontal_left", "vertical_up", "vertical_down")]), (F.col("direction") + 1).cast("int"))
    return m.select(
        "item_id", "label", "difficulty", "energy", labels.category_of(F.col("label")).alias("category"),
        labels.predicted_category(heading, F.col("coverage") * 4, F.col("label")).alias("p_category"),
        labels.predicted_difficulty(F.col("coverage") * 4, F.col("item_id") % 10 / 10.0).alias("p_difficulty"),
        labels.predicted_energy(F.col("speed_start"), F.col("coverage")).alias("p_energy"))


@query("prj36_predicted_labels", b.with_("motion", **PREDICT_SQL) + """
    select item_id, coalesce(p_category, 'none') as category, p_difficulty as difficulty, p_energy as energy from predicted""")
def prj36(spark, sf):
    return predicted_items(spark, sf).select(
        "item_id", F.coalesce("p_category", F.lit("none")).alias("category"),
        F.col("p_difficulty").alias("difficulty"), F.col("p_energy").alias("energy"))


CONSISTENT_SQL = dict(**PREDICT_SQL, consistent="""select item_id,
      (case when p_category is not null and category is not null then (p_category = category)::int else 0 end
       + (p_difficulty = difficulty)::int + (p_energy = energy)::int)
      / (2.0 + (p_category is not null and category is not null)::int) as score,
      array_to_string([zz for zz in ([case when p_category <> category then 'category' end,
        case when p_difficulty <> difficulty then 'difficulty' end,
        case when p_energy <> energy then 'energy' end]) if zz is not null], ',') as mismatches from predicted""")


def consistency(spark, sf):
    p = predicted_items(spark, sf)
    same = {k: F.col(f"p_{k}") == F.col(k) for k in ("category", "difficulty", "energy")}
    hits = F.array_compact(F.array(*[c.cast("double") for c in same.values()]))
    score = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.size(hits)
    wrong = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in same.items()]))
    return p.select("item_id", score.alias("score"), F.array_join(wrong, ",").alias("mismatches"))


@query("agg11_label_consistency", b.with_("motion", **CONSISTENT_SQL) + "select item_id, round(score, 6) as score, mismatches from consistent")
def agg11(spark, sf):
    return profiles.rounded(consistency(spark, sf))


@query("prj40_request_validation", b.with_("requests", req="""select req_id,
      case when req_id % 19 = 0 then 'expert' else difficulty end as difficulty,
      case when req_id % 5 = 0 then null when req_id % 23 = 0 then 'extreme' else energy end as energy,
      ['fast','balanced','high_quality','ultra'][req_id % 4 + 1] as quality_mode,
      case when req_id % 7 = 0 then null else (balance / 8)::int end as max_duration, (req_id % 400)::int as min_duration, role,
      case when req_id % 3 = 0 then null else [label_a, label_b] end as types,
      case when req_id % 6 = 0 then null when req_id % 29 = 0 then [100] else [75 + req_id % 60, 90 + req_id % 97] end as tempo_range
      from (select *, case when req_id % 2 = 0 then 'dips' else 'waltz' end as label_a,
        case when req_id % 10 = 1 then 'tango' else 'body_roll' end as label_b from requests)""") + """
    select req_id, array_to_string([zz for zz in ([
      case when difficulty not in ('beginner','intermediate','advanced') then 'difficulty' end,
      case when energy not in ('low','medium','high') then 'energy' end,
      case when quality_mode not in ('fast','balanced','high_quality') then 'quality_mode' end,
      case when max_duration not between 30 and 1200 then 'max_duration' end,
      case when min_duration not between 10 and 300 then 'min_duration' end,
      case when types is not null and not list_has_all(['dips','body_roll'], types) then 'types' end,
      case when len(tempo_range) <> 2 then 'tempo_range_size' end,
      case when len(tempo_range) = 2 and (tempo_range[1] < 80 or tempo_range[2] > 180) then 'tempo_range_bounds' end,
      case when len(tempo_range) = 2 and tempo_range[1] >= tempo_range[2] then 'tempo_range_order' end]) if zz is not null], ',') as errors from req""")
def prj40(spark, sf):
    r, key = b.requests(spark, sf), F.col("req_id")
    two = F.array(F.when(key % 2 == 0, "dips").otherwise("waltz"), F.when(key % 10 == 1, "tango").otherwise("body_roll"))
    span = F.when(key % 6 == 0, F.lit(None)).when(key % 29 == 0, F.array(F.lit(100).cast("long"))).otherwise(F.array(75 + key % 60, 90 + key % 97))
    fields = {
        "difficulty": F.when(key % 19 == 0, "expert").otherwise(F.col("difficulty")),
        "energy": F.when(key % 5 == 0, F.lit(None)).when(key % 23 == 0, "extreme").otherwise(F.col("energy")),
        "quality_mode": b.pick(["fast", "balanced", "high_quality", "ultra"], key),
        "max_duration": F.when(key % 7 == 0, F.lit(None)).otherwise(F.bround(F.col("balance") / 8).cast("int")),
        "min_duration": key % 400, "role": F.col("role"),
        "types": F.when(key % 3 == 0, F.lit(None)).otherwise(two), "tempo_range": span,
    }
    return r.select("req_id", F.array_join(labels.request_errors(fields), ",").alias("errors"))


@query("prj44_annotation_checks", b.with_("items", **RAW_SQL) + f"""
    select item_id, array_to_string([zz for zz in ([
      case when tempo not between 80 and 160 then 'issue:tempo_out_of_range' end,
      case when length(trim(notes)) < 10 then 'warning:notes_brief' end,
      case when {_any_sql('label', vocab.ADVANCED_LABELS)} and difficulty = 'beginner' then 'warning:advanced_label_for_beginner' end]) if zz is not null], ',') as notes_found from raw""")
def prj44(spark, sf):
    r = raw_items(spark, sf)
    found = labels.annotation_notes(F.col("tempo"), F.col("notes"), F.col("label"), F.col("difficulty"))
    return r.select("item_id", F.array_join(found, ",").alias("notes_found"))


@query("prj45_media_checks", """
    select page_id, array_to_string([zz for zz in ([case when d < 5 then 'too_short' end, case when d > 20 then 'too_long' end,
      case when w < 640 or h < 480 then 'low_resolution' end, case when fps < 24 then 'low_frame_rate' end]) if zz is not null], ',') as problems
    from (select page_id, length(html) / 500.0 as d, 480 + length(url) * 4 as w, 400 + length(url) * 2 as h, 20 + page_id % 11 as fps from pages)""")
def prj45(spark, sf):
    n_url, n = F.length("url"), F.length("html")
    p = labels.media_problems(n / 500.0, 480 + n_url * 4, 400 + n_url * 2, 20 + F.col("page_id") % 11)
    return b.table(spark, sf, "pages").select("page_id", F.array_join(p, ",").alias("problems"))


# --- filters -------------------------------------------------------------------------

@query("flt1_catalogue_filters", b.with_("items") + f"""
    select item_id, label, tempo from items where difficulty = 'beginner' and tempo between 100 and 125
      and coalesce({_first_sql('label', vocab.CATEGORY_RULES)}, '') in ('basic_step', 'dips', 'body_roll')""")
def flt1(spark, sf):
    cat = labels.category_of(F.col("label"))
    return b.items(spark, sf).where(
        (F.col("difficulty") == "beginner") & F.col("tempo").between(100, 125) & cat.isin("basic_step", "dips", "body_roll")
    ).select("item_id", "label", "tempo")


def faceted(df, difficulty=None, energy=None, role=None, types=None, tempo=None):
    """Conjunction of the facets that are given."""
    for col, value in (("difficulty", difficulty), ("energy", energy), ("role", role)):
        if value is not None:
            df = df.where(F.col(col) == value)
    if types:
        df = df.where(F.col("label").isin(types))
    if tempo:
        df = df.where(F.col("tempo").between(*tempo))
    return df


@query("flt4_faceted_filter", b.with_("items", hit="""select * from items where energy = 'high' and role = 'both'
      and label in ('dip', 'body_roll', 'basic_step', 'combination') and tempo between 95 and 140""") + """
    select item_id, label, (select count(*) from hit) as total from hit order by item_id limit 10""")
def flt4(spark, sf):
    """First ten matches and the total, as the report shows them."""
    hit = faceted(b.items(spark, sf), energy="high", role="both", types=["dip", "body_roll", "basic_step", "combination"], tempo=(95, 140))
    return hit.orderBy("item_id").limit(10).select("item_id", "label", hit.agg(F.count(F.lit(1))).scalar().alias("total"))


@query("flt5_metadata_search", """
    select doc_id, source from documents where (contains(lower(source), 'a') or contains(lower(lang), 'fr'))
      and n_chars between 200 and 20000 and lang in ('en', 'fr', 'de') order by n_chars desc, doc_id limit 50""")
def flt5(spark, sf):
    """Newest first, then the limit; the text column is never read."""
    d = b.table(spark, sf, "documents")
    named = F.lower("source").contains("a") | F.exists(F.array("lang"), lambda t: F.lower(t).contains("fr"))
    tagged = F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("fr"), F.lit("de")))
    return d.where(named & F.col("n_chars").between(200, 20000) & tagged).orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "source")


@query("flt6_lookup_delete", b.with_("items") + """
    select (select count(*) from items) as n_before, (select count(*) from items where item_id not in (select l_partkey from lineitem)) as n_after_delete,
      (select label from items where item_id = (select max(l_partkey) from lineitem)) as found_label""")
def flt6(spark, sf):
    """Point lookup by id, and a delete of every item that was ever sold."""
    i, li = b.items(spark, sf), b.table(spark, sf, "lineitem")
    top = li.agg(F.max("l_partkey")).scalar()
    left = upkeep.without(i, li.select(F.col("l_partkey").alias("item_id")), "item_id")
    return i.agg(F.count(F.lit(1)).alias("n_before")).select(
        "*", left.agg(F.count(F.lit(1))).scalar().alias("n_after_delete"),
        i.where(F.col("item_id") == top).agg(F.max("label")).scalar().alias("found_label"))


# --- statistics -----------------------------------------------------------------------

@query("agg1_collection_statistics", b.with_("items", **ERRORS_SQL) + """
    select count(*) as n, count(*) filter (difficulty = 'beginner') as n_beginner, count(*) filter (energy = 'high') as n_high,
      count(distinct label) as n_labels, min(tempo) as tempo_min, max(tempo) as tempo_max, count(*) filter (len(errors) > 0) as n_issues,
      case when count(*) filter (len(errors) > 0) < 0.1 * count(*) then 'good' else 'needs_attention' end as quality from checked""")
def agg1(spark, sf):
    issues = F.count_if(F.size("errors") > 0)
    return checked_items(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("difficulty") == "beginner").alias("n_beginner"),
        F.count_if(F.col("energy") == "high").alias("n_high"), F.count_distinct("label").alias("n_labels"),
        F.min("tempo").alias("tempo_min"), F.max("tempo").alias("tempo_max"), issues.alias("n_issues"),
        F.when(issues < F.count(F.lit(1)) * 0.1, "good").otherwise("needs_attention").alias("quality"))


@query("agg2_facet_counts", b.with_("items") + """
    select case when grouping(difficulty) = 0 then 'difficulty' when grouping(energy) = 0 then 'energy' when grouping(role) = 0 then 'role'
        when grouping(label) = 0 then 'label' else 'all' end as facet, coalesce(difficulty, energy, role, label, 'all') as value,
      count(*) as n, min(tempo) as tempo_min, max(tempo) as tempo_max, round(avg(tempo), 1) as tempo_avg
    from items group by grouping sets ((difficulty), (energy), (role), (label), ())""")
def agg2(spark, sf):
    return profiles.facet_counts(
        b.items(spark, sf), ["difficulty", "energy", "role", "label"],
        [F.min("tempo").alias("tempo_min"), F.max("tempo").alias("tempo_max"), F.round(F.avg("tempo"), 1).alias("tempo_avg")])


@query("agg3_tempo_distribution", """
    select count(*) as n, round(avg(t), 6) as mean, round(stddev_pop(t), 6) as std, round(min(t), 6) as min, round(max(t), 6) as max,
      round(median(t), 6) as median, round(100.0 * count(*) filter (t between 90 and 150) / count(*), 6) as in_range_pct,
      count(*) filter (t between 90 and 110) as slow, count(*) filter (t > 110 and t <= 130) as medium,
      count(*) filter (t > 130 and t <= 150) as fast, count(*) filter (t < 90 or t > 150) as outside
    from (select 85 + l_extendedprice / 1400 as t from lineitem)""")
def agg3(spark, sf):
    li = b.table(spark, sf, "lineitem").select((85 + F.col("l_extendedprice") / 1400).alias("tempo"))
    return profiles.rounded(profiles.tempo_distribution(li, "tempo"))


@query("agg4_two_measure_profile", """
    select round(avg(a), 6) as rhythm_mean, round(stddev_pop(a), 6) as rhythm_std, min(a) as rhythm_min, max(a) as rhythm_max,
      count(*) filter (a > 0.8) as rhythm_high, round(avg(s), 6) as sync_mean, round(stddev_pop(s), 6) as sync_std, min(s) as sync_min,
      max(s) as sync_max, round(100.0 * count(*) filter (s between 0.3 and 0.7) / count(*), 6) as sync_in_range_pct
    from (select round(l_quantity / 50, 6) as a, round(l_tax * 10, 6) as s from lineitem)""")
def agg4(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.round(F.col("l_quantity") / 50, 6).alias("a"), F.round(F.col("l_tax") * 10, 6).alias("s"))
    return profiles.rounded(li.agg(
        *profiles.spread("a", "rhythm_"), F.count_if(F.col("a") > 0.8).alias("rhythm_high"),
        *profiles.spread("s", "sync_"), profiles.share(F.col("s").between(0.3, 0.7)).alias("sync_in_range_pct")))


@query("agg5_child_histogram", """
    with sizes as (select l_orderkey, count(*) as c from lineitem group by 1)
    select r.c as children, (select count(*) from sizes where sizes.c = r.c) as parents
    from (select unnest(range((select min(c) from sizes), (select max(c) + 1 from sizes))) as c) r""")
def agg5(spark, sf):
    return profiles.child_histogram(b.table(spark, sf, "lineitem"), "l_orderkey")


@query("agg5_structure_summary", b.with_("items") + """
    select label, count(*) as n, round(avg(c), 6) as parents_mean from (
      select label, l_orderkey, count(*) as c from lineitem join items on l_partkey = item_id group by 1, 2) group by label""")
def agg5_types(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    per = li.join(b.items(spark, sf).select("item_id", "label"), "item_id").groupBy("label", "l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("parents_mean"))


@query("agg6_vector_quality", b.with_("vecs") + """
    select bool_and(len(vec) = 64) as right_dimension, round(avg(nz), 6) as mean_non_zero, round(avg(nz / 64.0), 6) as mean_ratio,
      round(avg(list_max(vec) - list_min(vec)), 6) as mean_range, bool_and(abs(list_sum(vec) / 64) < 0.1) as centred
    from (select vec, len([x for x in vec if x <> 0]) as nz from vecs)""")
def agg6(spark, sf):
    v = F.col("vec")
    nz = F.size(F.filter(v, lambda x: x != 0))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return profiles.rounded(b.vectors(spark, sf).agg(
        F.every(F.size(v) == 64).alias("right_dimension"), F.avg(nz).alias("mean_non_zero"),
        F.avg(nz / F.size(v)).alias("mean_ratio"), F.avg(F.array_max(v) - F.array_min(v)).alias("mean_range"),
        F.every(F.abs(mean) < 0.1).alias("centred")))


BALANCE_SQL = """(select case when count(*) <= 1 then 1.0 else -sum(p * log2(p)) / log2(count(*)) end
    from (select count(*) / sum(count(*)) over () as p from {src} group by {col}))"""


@query("agg7_balance_score", b.with_("items") + "select " + ", ".join(
    f"round({BALANCE_SQL.format(src='items', col=c)}, 6) as {c}_balance" for c in ("label", "difficulty", "energy")))
def agg7(spark, sf):
    return profiles.rounded(balances(b.items(spark, sf), ["label", "difficulty", "energy"]))


def balances(df, facets):
    """Balance score of each facet, one row, from one pass over the table."""
    counts = profiles.facet_counts(df, facets, []).where("facet <> 'all'")
    per = profiles.balance_score(counts, by=["facet"])
    return per.agg(*[F.max(F.when(F.col("facet") == f, F.col("balance"))).alias(f"{f}_balance") for f in facets])


@query("agg8_training_statistics", b.with_("items", **RAW_SQL, c=f"""select *, coalesce({_first_sql('label', vocab.CATEGORY_RULES)}, 'unknown') as category,
      (tempo // 10 * 10) || '-' || (tempo // 10 * 10 + 9) as tempo_bin from raw""") + """
    select case when grouping(category) = 0 then 'category' when grouping(difficulty) = 0 then 'difficulty' when grouping(energy) = 0 then 'energy'
        when grouping(tempo_bin) = 0 then 'tempo_bin' else 'all' end as facet, coalesce(category, difficulty, energy, tempo_bin, 'all') as value, count(*) as n
    from c group by grouping sets ((category), (difficulty), (energy), (tempo_bin), ())""")
def agg8(spark, sf):
    return profiles.facet_counts(training_rows(spark, sf), ["category", "difficulty", "energy", "tempo_bin"], [])


def training_rows(spark, sf):
    low = F.floor(F.col("tempo") / 10) * 10
    return raw_items(spark, sf).select(
        F.coalesce(labels.category_of(F.col("label")), F.lit("unknown")).alias("category"), "difficulty", "energy",
        F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")).alias("tempo_bin"))


@query("agg9_balance_advice", b.with_(c="""select o_orderstatus as category, case when o_orderpriority = '1-URGENT' then 'beginner' else 'advanced' end as difficulty,
      case when o_totalprice < 50000 then 'low' when o_totalprice < 200000 then 'medium' else 'high' end as energy from orders""",
    s="""select (select max(n) > 3 * min(n) from (select count(*) n from c group by category)) as a, count(*) filter (difficulty = 'beginner') * 1.0 / count(*) as r,
      (select max(n) > 2 * min(n) from (select count(*) n from c group by energy)) as e, count(*) as n from c""") + """
    select unnest([zz for zz in ([case when a then 'add_underrepresented_categories' end,
      case when r < 0.2 then 'add_beginner' when r > 0.6 then 'add_harder' end, case when e then 'balance_energy' end,
      case when n < 50 then 'expand_dataset' end]) if zz is not null]) as advice from s""")
def agg9(spark, sf):
    """Advice on the orders as a collection: status as category, urgency as difficulty, price as level."""
    price = F.col("o_totalprice")
    rows = b.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("category"), F.when(F.col("o_orderpriority") == "1-URGENT", "beginner").otherwise("advanced").alias("difficulty"),
        F.when(price < 50000, "low").when(price < 200000, "medium").otherwise("high").alias("energy"))
    return balance_advice(profiles.facet_counts(rows, ["category", "difficulty", "energy"], []))


def balance_advice(counts):
    """Advice rows from facet counts (facet, value, n)."""
    def of(facet, fn):
        return fn(F.when(F.col("facet") == facet, F.col("n")))

    total = of("all", F.max)
    beginner = F.coalesce(F.max(F.when((F.col("facet") == "difficulty") & (F.col("value") == "beginner"), F.col("n"))), F.lit(0)) / total
    advice = F.array_compact(F.array(
        F.when(of("category", F.max) > 3 * of("category", F.min), F.lit("add_underrepresented_categories")),
        F.when(beginner < 0.2, F.lit("add_beginner")).when(beginner > 0.6, F.lit("add_harder")),
        F.when(of("energy", F.max) > 2 * of("energy", F.min), F.lit("balance_energy")),
        F.when(total < 50, F.lit("expand_dataset"))))
    return counts.agg(advice.alias("advice")).select(F.explode("advice").alias("advice"))


# --- joins on the catalogue -------------------------------------------------------------

def _template_sql(t):
    _, d, e, r, tempo, types = t
    conds = [f"{c} = '{v}'" for c, v in (("difficulty", d), ("energy", e), ("role", r)) if v]
    if tempo:
        conds.append(f"tempo between {tempo[0]} and {tempo[1]}")
    if types:
        conds.append("label in (" + ",".join(f"'{x}'" for x in types) + ")")
    return f"select '{t[0]}' as template, count(*) as available, count(*) > 0 as validated from items where " + " and ".join(conds)


@query("jon15_template_matches", b.with_("items") + " union all ".join(_template_sql(t) for t in vocab.TEMPLATES))
def jon15(spark, sf):
    """The catalogue is reduced to counts per attribute combination first."""
    facets = ["difficulty", "energy", "role", "tempo", "label"]
    classes = b.items(spark, sf).groupBy(*facets).agg(F.count(F.lit(1)).alias("n"))

    def hit(t):
        cond = F.lit(True)
        for col, v in zip(("difficulty", "energy", "role"), t[1:4]):
            if v:
                cond = cond & (F.col(col) == v)
        if t[4]:
            cond = cond & F.col("tempo").between(*t[4])
        if t[5]:
            cond = cond & F.col("label").isin(list(t[5]))
        return F.struct(F.lit(t[0]).alias("template"), cond.alias("hit"))

    return upkeep.template_matches(classes, F.array(*[hit(t) for t in vocab.TEMPLATES]))


@query("jon16_reconciliation", b.with_("items", listing="select case when page_id % 3 = 0 then 'styling' when page_id % 3 = 1 then 'advanced' else 'inbox' end || '/' || page_id || '.mp4' as path from pages",
    want=f"""select item_id, case when item_id % 4 = 0 then 'styling' when item_id % 4 = 1 then 'advanced' else 'inbox' end || '/' || item_id || '.mp4' as path,
      {_first_sql('label', list(vocab.GROUPS.items()), "'advanced'")} || '/' || item_id || '.mp4' as target from items""") + """
    select status, count(*) as n from (select case when path not in (select path from listing) then 'missing' when path = target then 'already_organized'
      when target in (select path from listing) then 'target_exists' else 'to_move' end as status from want) group by status""")
def jon16(spark, sf):
    from ..functions.labels import _first_match

    def folder(key, m):
        return F.when(key % m == 0, "styling").when(key % m == 1, "advanced").otherwise("inbox")

    page, item = F.col("page_id"), F.col("item_id")
    listing = b.table(spark, sf, "pages").select(F.concat(folder(page, 3), F.lit("/"), page.cast("string"), F.lit(".mp4")).alias("path"))
    cat = b.items(spark, sf).select("item_id", "label", F.concat(folder(item, 4), F.lit("/"), item.cast("string"), F.lit(".mp4")).alias("path"))
    group = _first_match(F.col("label"), list(vocab.GROUPS.items())).otherwise("advanced")
    target = F.concat(group, F.lit("/"), item.cast("string"), F.lit(".mp4"))
    return upkeep.reconcile(cat, listing, "path", target).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("jon18_rating_override", """
    select d.doc_id, coalesce(l.quality::double, round(least(1.0, n_chars / 5000.0), 6)) as rating, l.quality is not null as is_expert
    from documents d left join labels l using (doc_id)""")
def jon18(spark, sf):
    """An expert rating replaces the computed quality where there is one."""
    d = b.table(spark, sf, "documents").select("doc_id", "n_chars")
    own = F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 6)
    return d.join(b.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("double"), own).alias("rating"), F.col("quality").isNotNull().alias("is_expert"))


# --- sets and upkeep -----------------------------------------------------------------------

#: Every new key comes twice, with two labels; labels that are not known are no annotations.
NEW_SQL = """select c_custkey // 2 + 1500 as item_id, c_custkey as seq, case when c_custkey % 7 = 0 then 'unknown' else 'basic_step' end as label from customer"""


@query("src5_append_with_guard", b.with_("items", new=NEW_SQL, good="select * from new where label <> 'unknown' and item_id not in (select item_id from items) qualify row_number() over (partition by item_id order by seq) = 1") + """
    select (select count(*) from items) + count(*) as n_rows, (select count(*) from items) + count(distinct item_id) as n_unique,
      (select count(*) from new) - count(*) as n_rejected, sum(seq)::bigint as seqs from good""")
def src5(spark, sf):
    old = b.items(spark, sf).select("item_id", F.lit(None).cast("long").alias("seq"), "label")
    key = F.col("c_custkey")
    new = b.table(spark, sf, "customer").select(
        (F.floor(key / 2) + 1500).alias("item_id"), key.alias("seq"), F.when(key % 7 == 0, "unknown").otherwise("basic_step").alias("label"))
    total = new.agg(F.count(F.lit(1))).scalar() + old.agg(F.count(F.lit(1))).scalar()
    n = F.count(F.lit(1))
    return upkeep.append_new(old, new, "item_id", "seq", F.col("label").isin(vocab.LABELS)).agg(
        n.alias("n_rows"), F.count_distinct("item_id").alias("n_unique"), F.sum("seq").alias("seqs")).withColumn("n_rejected", total - F.col("n_rows"))


#: Up to three patches of a key, in order; one may take a row out of the limits of the catalogue.
PATCHES = dict(patches="""select item_id, 1 as seq, 100 + item_id % 80 as tempo, null::double as duration from items where item_id % 3 = 0
      union all select item_id, 2, null, 10.5 from items where item_id % 6 = 0
      union all select item_id, 3, 90, case when item_id % 8 = 0 then 25.0 end from items where item_id % 12 = 0""",
    laid="select item_id, arg_max(tempo, seq) filter (tempo is not null) as tempo, arg_max(duration, seq) filter (duration is not null) as duration from patches group by 1",
    patched="select i.item_id, i.tempo, i.duration, coalesce(l.tempo, i.tempo) as t, coalesce(l.duration, i.duration) as d from items i left join laid l using (item_id)")


@query("src6_update_by_key", b.with_("items", **PATCHES) + f"""
    select item_id, case when ok then t else tempo end as tempo, case when ok then d else duration end::double as duration
    from (select *, t between {vocab.MIN_TEMPO} and {vocab.MAX_TEMPO} and d between {vocab.MIN_CLIP_SECONDS} and {vocab.MAX_CLIP_SECONDS} as ok from patched)""")
def src6(spark, sf):
    i = b.items(spark, sf).select("item_id", "tempo", "duration")
    key = F.col("item_id")

    def step(seq, every, tempo, seconds):
        return i.where(key % every == 0).select("item_id", F.lit(seq).alias("seq"), tempo.cast("int").alias("tempo"), seconds.cast("double").alias("duration"))

    none = F.lit(None)
    fixes = step(1, 3, 100 + key % 80, none).unionByName(step(2, 6, none, F.lit(10.5))).unionByName(step(3, 12, F.lit(90), F.when(key % 8 == 0, 25.0)))
    valid = F.col("tempo").between(vocab.MIN_TEMPO, vocab.MAX_TEMPO) & F.col("duration").between(vocab.MIN_CLIP_SECONDS, vocab.MAX_CLIP_SECONDS)
    return upkeep.patch(i, fixes, "item_id", "seq", valid)


@query("set1_union", """
    select l_partkey as item_id, 'sold' as origin, l_quantity as amount from lineitem
    union all select p_partkey, 'listed', p_retailprice from part""")
def set1(spark, sf):
    sold = b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.lit("sold").alias("origin"), F.col("l_quantity").alias("amount"))
    listed = b.table(spark, sf, "part").select(
        F.lit("listed").alias("origin"), F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("amount"))
    return sold.unionByName(listed)


@query("set2_distinct", b.with_("items") + "select distinct label, role from items")
def set2(spark, sf):
    return b.items(spark, sf).select("label", "role").distinct()


@query("set3_difference", "select c_custkey as user_id from customer except select user_id from events")
def set3(spark, sf):
    """Customers without an event."""
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(b.table(spark, sf, "events").select("user_id"), "user_id", "left_anti")


@query("set4_intersection", "select c_custkey as user_id from customer intersect select user_id from events")
def set4(spark, sf):
    """Customers with an event."""
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).intersect(b.table(spark, sf, "events").select("user_id"))


@query("set5_incremental_load", """
    select count(*) as n_new from (select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1)""")
def set5(spark, sf):
    """Orders that the line table does not have yet."""
    stored = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    seen = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    return seen.join(stored, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_new"))


@query("jon19_set_overlap", b.with_("slots", s="""select seq_id, list_distinct(list(label)) as actual,
      avg(similarity) as q from slots group by 1""") + """
    select seq_id, round((1 - abs(q - 0.8)
       + len(list_intersect(actual, e))::double / len(list_distinct(list_concat(actual, e)))) / 2, 6) as accuracy
    from (select *, ['basic_step','dip','combination','hammerlock'] as e from s)""")
def jon19(spark, sf):
    """Mean of quality agreement and label overlap with the expected set."""
    per = b.slots(spark, sf).groupBy("seq_id").agg(F.collect_set("label").alias("actual"), F.avg("similarity").alias("q"))
    return per.select("seq_id", F.round(truth_accuracy(
        F.col("q"), F.lit(0.8), F.col("actual"), F.array(*[F.lit(x) for x in ("basic_step", "dip", "combination", "hammerlock")])), 6).alias("accuracy"))


def truth_accuracy(quality, expected_quality, actual, expected):
    """Mean of 1 - |q - expected| and Jaccard, each only where its truth is given."""
    close = 1.0 - F.abs(quality - expected_quality)
    overlap = F.try_divide(F.size(F.array_intersect(actual, expected)), F.size(F.array_union(actual, expected)))
    parts = F.array_compact(F.array(close, overlap))
    return F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts)), quality)


# --- song ranking -----------------------------------------------------------------------------

QUALITY_SQL = """case when tempo between 90 and 150 then 1.0 else 0.5 end * 0.3 + rhythm * 0.4
    + case when sync between 0.3 and 0.7 then 1.0 else 0.7 end * 0.2 + least(1.0, sections / 6.0) * 0.1"""
SONGS_SQL = dict(songs="""select o_orderkey as song_id, 85 + o_totalprice / 7000 as tempo, (o_orderkey % 100) / 100.0 as rhythm,
    (o_custkey % 97) / 97.0 as sync, 1 + o_orderkey % 9 as sections from orders""")


def songs(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("song_id"), (85 + F.col("o_totalprice") / 7000).alias("tempo"),
        (F.col("o_orderkey") % 100 / 100.0).alias("rhythm"), (F.col("o_custkey") % 97 / 97.0).alias("sync"),
        (1 + F.col("o_orderkey") % 9).alias("sections"))


def song_quality(tempo, rhythm, sync, sections):
    return (
        F.when(tempo.between(90, 150), 1.0).otherwise(0.5) * 0.3 + rhythm * 0.4
        + F.when(sync.between(0.3, 0.7), 1.0).otherwise(0.7) * 0.2 + F.least(F.lit(1.0), sections / 6.0) * 0.1)


@query("prj35_style_and_quality", b.with_(**SONGS_SQL) + f"""
    select song_id, case when tempo < 115 then 'Romantic/Slow' when tempo > 135 then 'Modern/Fast' else 'Traditional' end as style,
      round({QUALITY_SQL}, 6) as quality from songs""")
def prj35(spark, sf):
    t = F.col("tempo")
    return songs(spark, sf).select(
        "song_id", F.when(t < 115, "Romantic/Slow").when(t > 135, "Modern/Fast").otherwise("Traditional").alias("style"),
        F.round(song_quality(t, F.col("rhythm"), F.col("sync"), F.col("sections")), 6).alias("quality"))


@query("top16_song_ranking", b.with_(**SONGS_SQL, q=f"select song_id, round({QUALITY_SQL}, 6) as quality from songs") + """
    select song_id, quality, rank() over (order by quality desc) as place from q""")
def top16(spark, sf):
    """Place of every song; equal qualities share a place, so copies are counted before any ordering."""
    q = prj35(spark, sf).select("song_id", "quality").withColumn("worse", -F.col("quality"))
    counts = q.groupBy("worse").agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counts, [], ["worse"], F.floor(F.col("worse") * 500), {"total": F.col("n")})
    return q.join(upto.select("worse", (F.col("total") - F.col("n") + 1).alias("place")), "worse").drop("worse")


@query("prj28_tempo_features", b.with_("requests") + """
    select req_id, round(ln(tempo / 60), 6) as tempo_log, round(60.0 / tempo, 6) as period, (tempo >= 100 and tempo < 120)::int::double as medium_slow,
      round(tempo * r, 6) as effective, round(greatest(0, 1 - abs(tempo - 100) / 25, 1 - abs(tempo - 120) / 25, 1 - abs(tempo - 140) / 25), 6) as fit,
      round(case when tempo < 90 then least(1, tempo / 90) else least(1, 180.0 / tempo) end, 6) as extremeness, 15::int as n_features
    from (select *, (req_id % 10) / 10.0 as r from requests)""")
def prj28(spark, sf):
    r = F.col("req_id") % 10 / 10.0
    f = b.requests(spark, sf).select("req_id", music.tempo_features(F.col("tempo"), r, F.lit(0.4)).alias("f"))
    at = lambda i: F.get("f", i)
    return profiles.rounded(f.select(
        "req_id", at(5).alias("tempo_log"), at(7).alias("period"), at(1).alias("medium_slow"), at(8).alias("effective"),
        at(14).alias("fit"), at(12).alias("extremeness"), F.size("f").alias("n_features")))


@query("prj29_tempo_accuracy", b.with_("requests") + """
    select req_id, tempo between 90 and 150 and (e is null or abs(tempo - e) <= e * 0.05) as accurate
    from (select *, case when req_id % 4 = 0 then null else 100.0 + req_id % 37 end as e from requests)""")
def prj29(spark, sf):
    e = F.when(F.col("req_id") % 4 != 0, 100.0 + F.col("req_id") % 37)
    return b.requests(spark, sf).select("req_id", music.tempo_is_accurate(F.col("tempo"), e).alias("accurate"))
