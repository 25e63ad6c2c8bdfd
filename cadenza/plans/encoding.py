"""Spaces of the unified vector and searches on it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encode, labels, scores, text, vectors, vocab
from ..operators import graph
from ..operators.bounded import classed_topk
from ..operators.diversity import capped_topk
from ..operators.nearest import CategoricalBlend, TempoBlend, Within, cosine_score
from ..operators.profiles import rounded
from ..session import written
from . import binding as b
from .registry import query
from .scoring import TOPK_SQL, pool_size

RANK = b.sql_rank
ROLES = ["both", "lead_focus", "follow_focus"]
SPACES = vocab.SPACE_WEIGHTS


def _number_sql(v, lo, hi):
    x = f"(({v} - {lo}) / ({hi} - {lo}) * 2.0 - 1.0)"
    return "[" + ",".join(f"{'sin' if i % 2 == 0 else 'cos'}({(i + 1) * math.pi / 8!r} * {x})" for i in range(8)) + "]"


ENERGY_SQL = ("[case energy when 'high' then 1.0 when 'medium' then 0.3 else 0.0 end, case energy when 'low' then 1.0 when 'medium' then 0.3 else 0.0 end,"
              " case energy when 'medium' then 1.0 else 0.2 end]")
ROLE_SQL = "[(role = 'both')::int, (role = 'follow_focus')::int, (role = 'lead_focus')::int]"
BUCKET = "(('0x' || substr(md5({x}), 1, 8))::bigint % {n})"


def _text_pos_sql(t):
    h = BUCKET.format(x=t, n=384)
    return f"list_distinct([({h} + unicode(substr({t}, i::int, 1))) % 384 for i in range(1, least(10, length({t})) + 1)])"


@query("prj7_number_sinusoid", b.with_("items", v=f"select item_id, {_number_sql('tempo', 90.0, 150.0)} as s from items") + """
    select item_id, round(s[1], 6) as first_entry, round(s[8], 6) as last_entry, round(list_sum(s), 6) as total from v""")
def prj7(spark, sf):
    s = encode.number_space(F.col("tempo").cast("double"), *vocab.TEMPO_SPAN)
    return rounded(b.items(spark, sf).select("item_id", s.alias("s")).select(
        "item_id", F.get("s", 0).alias("first_entry"), F.get("s", 7).alias("last_entry"), vectors.vec_sum(F.col("s")).alias("total")))


@query("prj8_soft_one_hot", b.with_("items", v=f"select item_id, {ENERGY_SQL} as e, {ROLE_SQL} as r from items") + """
    select item_id, e[1]::double as e_high, e[2]::double as e_low, e[3]::double as e_medium, r[1]::double as r_both, r[2]::double as r_follow, r[3]::double as r_lead from v""")
def prj8(spark, sf):
    e, r = encode.energy_space(F.col("energy")), encode.role_space(F.col("role"))
    return b.items(spark, sf).select(
        "item_id", *[F.get(e, i).alias(f"e_{n}") for i, n in enumerate(("high", "low", "medium"))],
        *[F.get(r, i).alias(f"r_{n}") for i, n in enumerate(("both", "follow", "lead"))])


@query("prj9_hashed_multi_hot", b.with_("slots", p=f"""select seq_id, len(list_distinct(flatten(list([{','.join(BUCKET.format(x=f"item_id || '{s}'", n=64) for s in vocab.TRANSITION_SEEDS)}])))) as n_set from slots group by 1""") + """
    select seq_id, n_set::double as n_set, round(1 / sqrt(n_set), 6) as entry from p""")
def prj9(spark, sf):
    """The items of a sequence hashed into 64 positions; a position is kept once, however many items set it."""
    spots = b.slots(spark, sf).select("seq_id", F.explode(encode.hashed_spots(F.col("item_id"))).alias("spot"))
    v = spots.groupBy("seq_id").agg(vectors.l2_normalize(vectors.multi_hot(F.collect_set("spot"), vocab.TRANSITION_DIM)).alias("v"))
    return rounded(v.select("seq_id", vectors.vec_sum(F.transform("v", lambda x: F.when(x > 0, 1.0).otherwise(0.0))).alias("n_set"),
                            F.array_max("v").alias("entry")))


@query("prj10_hashed_text", f"select doc_id, len(p)::int as n_set, list_sum(p)::bigint as position_sum from (select doc_id, {_text_pos_sql('text')} as p from documents)")
def prj10(spark, sf):
    p = encode.text_positions(F.col("text"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    # A text without characters, or none at all, sets no position and has no sum.
    return b.table(spark, sf, "documents").select("doc_id", p.alias("p")).select(
        "doc_id", F.size("p").alias("n_set"), F.when(F.size("p") > 0, total).alias("position_sum"))


# --- unified vectors --------------------------------------------------------------------

#: What the vector of an item depends on: items that agree on these are one class.
UNIFIED = ["said_spots", "tempo", "difficulty", "energy", "role", "next_spots"]


def unified_keys(spark, sf):
    """Items with the positions that their text and their hashed neighbours set."""
    i = b.items(spark, sf)
    spots = F.array(*[
        encode.md5_bucket(F.concat(F.col("item_id").cast("string"), F.lit(str(s))), vocab.TRANSITION_DIM).cast("int")
        for s in vocab.TRANSITION_SEEDS])
    said = labels.describe(F.col("label"), F.col("energy"), F.col("difficulty"), F.col("notes"))
    return graph.with_neighbour_spots(i, spots, "next_spots").withColumn("said_spots", F.array_sort(encode.text_positions(said)))


def with_unified(df):
    """Adds the 470-entry vector of rows of `unified_keys`; the transition space holds the hashed neighbours."""
    return df.withColumn("vec", encode.unified(
        vectors.multi_hot(F.col("said_spots"), vocab.TEXT_DIM), F.col("tempo").cast("double"), scores.level_rank(F.col("difficulty")), F.col("energy"),
        F.col("role"), vectors.l2_normalize(vectors.multi_hot(F.col("next_spots"), vocab.TRANSITION_DIM)), SPACES))


def query_vectors(reqs, said, weights):
    """Requests with the vector of the same spaces; no text gives a zero text part."""
    body = encode.text_space(said) if said is not None else vectors.zeros(vocab.TEXT_DIM)
    return reqs.withColumn("vec", encode.unified(
        body, F.col("tempo"), scores.level_rank(F.col("difficulty")), F.col("energy"), F.col("role"),
        vectors.zeros(vocab.TRANSITION_DIM), weights))


COMPAT_SQL = f"""(abs({RANK('a.energy')} - {RANK('c.energy')}) <= 1 or abs({RANK('a.difficulty')} - {RANK('c.difficulty')}) <= 1 or a.label = 'basic_step'
    or (a.label in ('cross_body_lead', 'double_cross_body_lead') and (contains(c.label, 'turn') or c.label = 'basic_step'))
    or (a.label not in ('cross_body_lead', 'double_cross_body_lead') and contains(a.label, 'turn') and (c.label = 'basic_step' or contains(c.label, 'turn'))))"""


def _hot_sql(pos, n):
    return f"[case when list_contains({pos}, i) then 1.0 else 0.0 end for i in range(0, {n})]"


def _scale_sql(v, w):
    return f"[x * {w} for x in {v}]"


def _unified_sql(text_v, trans_v, weights):
    parts = {
        "text": text_v, "tempo": _number_sql("tempo", 90.0, 150.0), "difficulty": _number_sql(RANK("difficulty"), 1.0, 3.0),
        "energy": ENERGY_SQL, "role": ROLE_SQL, "transition": trans_v}
    out = None
    for k, v in parts.items():
        piece = f"({_scale_sql(v, weights[k])})::double[]"
        out = piece if out is None else f"list_concat({out}, {piece})"
    return out


SAID = "difficulty || ' ' || energy || ' energy ' || replace(label, '_', ' ') || ' - ' || notes"
UNIFIED_SQL = dict(
    bits=f"""select item_id, unnest([{','.join(BUCKET.format(x=f"item_id || '{s}'", n=64) for s in vocab.TRANSITION_SEEDS)}]) as bit from items""",
    nb=f"select a.item_id, bit from items a join items c on a.item_id <> c.item_id and {COMPAT_SQL} join bits on bits.item_id = c.item_id group by 1, 2",
    hashed="select item_id, list(bit) as p from nb group by 1",
    unified=f"""select *, {_unified_sql(_hot_sql(_text_pos_sql('said'), 384), "[x / sqrt(len(p)) for x in " + _hot_sql('p', 64) + "]", SPACES)} as uvec
      from (select *, {SAID} as said from items) join hashed using (item_id)""")


@query("prj11_unified_vector", b.with_("items", **UNIFIED_SQL) + """
    select item_id, len(uvec)::int as dim, round(sqrt(list_sum([x * x for x in uvec])), 6) as length, round(list_sum(uvec[1:384]), 6) as text_sum,
      round(list_sum(uvec[407:470]), 6) as transition_sum from unified""")
def prj11(spark, sf):
    """The vector of a class of items is built once."""
    keys, v = unified_keys(spark, sf).select("item_id", *UNIFIED), F.col("vec")
    told = with_unified(keys.select(*UNIFIED).distinct()).select(
        *UNIFIED, F.size(v).alias("dim"), vectors.norm(v).alias("length"), vectors.vec_sum(F.slice(v, 1, 384)).alias("text_sum"),
        vectors.vec_sum(F.slice(v, 407, 64)).alias("transition_sum"))
    return rounded(keys.join(told.hint("merge"), UNIFIED).drop(*UNIFIED))


ASK = "style || ' ' || energy || ' ' || difficulty"
SEMANTIC = {"text": 0.7, "tempo": 0.3 * 0.4, "difficulty": 0.3 * 0.2, "energy": 0.3 * 0.2, "role": 0.3 * 0.1, "transition": 0.3 * 0.1}
TEMPO_ONLY = {"text": 0.0, "tempo": 1.0, "difficulty": 0.0, "energy": 0.0, "role": 0.0, "transition": 0.0}
TEXT_ONLY = {**TEMPO_ONLY, "text": 1.0, "tempo": 0.0}


def _zeros_sql(n):
    return f"[0.0 for i in range(0, {n})]"


def _asked_sql(weights, said=ASK):
    body = _hot_sql(_text_pos_sql("said"), 384) if said else _zeros_sql(384)
    return dict(asked=f"select *, {_unified_sql(body, _zeros_sql(64), weights)} as qvec from (select *, {said or 'null'} as said from requests)")


def _search_sql(k):
    return dict(near="""select req_id, item_id, round(coalesce(nullif(list_cosine_similarity(qvec, uvec), 'nan'::double), 0), 9) as score from asked, unified""",
                best=f"select * from ({TOPK_SQL.format(src='near')}) where rank <= {k}")


@query("prj12_query_vector", b.with_("requests", **_asked_sql(SPACES)) + """
    select req_id, len(qvec)::int as dim, round(sqrt(list_sum([x * x for x in qvec])), 6) as length, round(list_sum(qvec[385:392]), 6) as tempo_sum from asked""")
def prj12(spark, sf):
    """Requests of one class have one query vector, which is built once."""
    members, q = request_classes(spark, sf, F.concat_ws(" ", "style", "energy", "difficulty"), SPACES)
    v = F.col("vec")
    return to_members(rounded(q.select("req_id", F.size(v).alias("dim"), vectors.norm(v).alias("length"), vectors.vec_sum(F.slice(v, 385, 8)).alias("tempo_sum"))), members)


#: What a query vector depends on: requests that agree on these are one class.
ASKED = ["style", "energy", "difficulty", "tempo", "role"]


def request_classes(spark, sf, words, weights, keep=()):
    """(req_id, rep) and the query vector of each rep, the smallest request of its class."""
    asked = b.requests(spark, sf)
    reps = asked.groupBy(*ASKED).agg(F.min("req_id").alias("rep"))
    members = asked.join(reps, ASKED).select("req_id", "rep")
    vecs = query_vectors(reps, words, weights).select(F.col("rep").alias("req_id"), "vec", *keep)
    return members, vecs


def to_members(found, members):
    """What was worked out for the smallest request of a class, for all of them; a class is hot where requests are alike."""
    return members.join(found.withColumnRenamed("req_id", "rep"), "rep").drop("rep")


#: Rows of a cell: a unified vector has 470 entries.
UNIFIED_CELL = 1 << 14


def _class_search(spark, sf, words, weights, k, scorer, attributes):
    """The k best items of the smallest request of each class, and the members of the classes."""
    own = [v.alias(c) for c, v in attributes.items()]
    members, asked = request_classes(spark, sf, words, weights, own)
    asked = written(asked, "asked")
    found = unified_keys(spark, sf).select("item_id", *UNIFIED)

    def with_vec(df):
        return with_unified(df).withColumns(attributes)

    return classed_topk(asked, found, "req_id", "item_id", k, scorer, list(attributes), asked.count(), UNIFIED, with_vec, cell_right=UNIFIED_CELL), members


def class_search(spark, sf, weights, k, said=True):
    words = F.concat_ws(" ", "style", "energy", "difficulty") if said else None
    return _class_search(spark, sf, words, weights, k, Within(cosine_score), {})


def search(spark, sf, weights, k, said=True):
    """The k items nearest to each request; requests of one class are searched once."""
    return to_members(*class_search(spark, sf, weights, k, said))


def blended_classes(spark, sf, words, weights, k, scorer, classes):
    """The k items of the highest blend for the smallest request of each class, and the members; the blend and its limits count before the ranking."""
    attributes = {
        "tempo": F.col("tempo").cast("double"), "energy_rank": scores.level_rank(F.col("energy")),
        "difficulty_rank": scores.level_rank(F.col("difficulty")), "role_code": F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))}
    return _class_search(spark, sf, words, weights, k, scorer, {c: attributes[c] for c in classes})


def tempo_classes(spark, sf, k, tolerance):
    words = F.concat_ws(" ", "style", "energy", "difficulty")
    return blended_classes(spark, sf, words, vocab.TEMPO_SEARCH_WEIGHTS, k, TempoBlend(tolerance), ["tempo"])


def categorical_classes(spark, sf, k):
    words = F.concat(F.col("energy"), F.lit(" energy moves for "), F.col("role"))
    return blended_classes(spark, sf, words, vocab.CATEGORICAL_SEARCH_WEIGHTS, k, CategoricalBlend(), ["energy_rank", "role_code", "difficulty_rank"])


def for_requests(best, members):
    return to_members(best, members).select("req_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _single_space(name, weights, said):
    @query(name, b.with_("requests", "items", **UNIFIED_SQL, **_asked_sql(weights, ASK if said else None), **_search_sql(5)) + """
        select req_id, item_id, round(score, 6) as similarity, rank from best""")
    def run(spark, sf):
        return search(spark, sf, weights, 5, said).select("req_id", "item_id", F.round("score", 6).alias("similarity"), "rank")


_single_space("top4_semantic_search", SEMANTIC, True)
_single_space("top4_tempo_search", TEMPO_ONLY, False)
_single_space("top4_text_search", TEXT_ONLY, True)


@query("top5_tempo_rerank", b.with_("requests", "items", **UNIFIED_SQL, **_asked_sql(vocab.TEMPO_SEARCH_WEIGHTS), **_search_sql(20),
      mixed="""select req_id, item_id, round(0.3 * score + 0.7 * (1 - abs(i.tempo - r.tempo) / 10.0), 9) as score
        from near join requests r using (req_id) join items i using (item_id) where abs(i.tempo - r.tempo) <= 10""") + f"""
    select req_id, item_id, round(score, 6) as score, rank from ({TOPK_SQL.format(src='mixed')}) where rank <= 10""")
def top5(spark, sf):
    return for_requests(*tempo_classes(spark, sf, 10, 10.0))


WANTED = "energy || ' energy moves for ' || role"


@query("flt8_categorical_blend", b.with_("requests", "items", **UNIFIED_SQL, **_asked_sql(vocab.CATEGORICAL_SEARCH_WEIGHTS, WANTED), **_search_sql(20),
      blend=f"""select req_id, item_id, score, 0.4 * (case abs({RANK('r.energy')} - {RANK('i.energy')}) when 0 then 1.0 when 1 then 0.7 else 0.3 end)::double
        + 0.4 * (case when r.role = 'both' or i.role = 'both' or r.role = i.role then 1.0 else 0.6 end)::double
        + 0.2 * greatest(0.0, 1.0 - abs({RANK('r.difficulty')} - {RANK('i.difficulty')}) / 2.0) as cat
        from near join requests r using (req_id) join items i using (item_id)""",
      mixed="select req_id, item_id, round(0.5 * score + 0.5 * cat, 9) as score from blend where round(cat, 9) >= 0.6") + f"""
    select req_id, item_id, round(score, 6) as score, rank from ({TOPK_SQL.format(src='mixed')}) where rank <= 10""")
def flt8(spark, sf):
    return for_requests(*categorical_classes(spark, sf, 10))


@query("top10_oversampled_recommend", b.with_("requests", "items", **UNIFIED_SQL, **_asked_sql(SPACES), **_search_sql(30),
      cat="select b.*, label, row_number() over (partition by req_id, label order by rank) as in_cat from best b join items using (item_id)",
      picked="select *, in_cat <= 1 and sum((in_cat <= 1)::int) over (partition by req_id order by rank) <= 5 as pick from cat",
      slotted="select *, row_number() over (partition by req_id order by pick desc, rank) as slot from picked") + """
    select req_id, item_id, row_number() over (partition by req_id order by rank) as place,
      case when score > 0.8 then 'Excellent' when score > 0.6 then 'Good' when score > 0.4 then 'Moderate' else 'Basic' end || ' match with ' ||
      case when g <= 5 then 'perfect tempo match' when g <= 10 then 'close tempo (±' || round(g)::bigint || ' BPM)'
        else 'tempo adaptation needed (±' || round(g)::bigint || ' BPM)' end || ', ' || energy || ' energy ' || label || ' - ' || notes as explanation
    from (select s.req_id, s.item_id, s.rank, s.score, i.energy, i.label, i.notes, abs(i.tempo - r.tempo) as g
      from slotted s join items i using (item_id) join requests r using (req_id) where slot <= 5)""")
def top10(spark, sf):
    return recommend(spark, sf, 5)


def recommend(spark, sf, k, mode="ordered", seed=0):
    """Fetch max(5k, 30), spread over labels, keep k, explain each; in rank order all requests of a class get the same."""
    found, members = class_search(spark, sf, SPACES, pool_size(k))
    if mode != "ordered":  # each request draws its own
        found, members = to_members(found, members), members.select("req_id", F.col("req_id").alias("rep"))
    labelled = found.join(b.items(spark, sf).select("item_id", "label").hint("merge"), "item_id")
    kept = capped_topk(labelled, "req_id", "label", k, mode=mode, seed=seed).select("req_id", "item_id", "place", "score")
    wanted = b.requests(spark, sf).select("req_id", F.col("tempo").alias("want"))
    j = kept.join(wanted.hint("merge"), "req_id").join(b.items(spark, sf).hint("merge"), "item_id")
    told = text.match_explanation(F.col("score"), F.abs(F.col("tempo") - F.col("want")), F.col("energy"), F.col("label"), F.col("notes"))
    return to_members(j.select("req_id", "item_id", "place", told.alias("explanation")), members)


@query("top11_preview_sample", b.with_("items", hit="select item_id, label, abs(tempo - 115) as gap from items where difficulty = 'beginner' and tempo between 100 and 130",
      top="select *, row_number() over (order by gap, item_id) as rank from hit",
      cat="select *, row_number() over (partition by label order by rank) as in_cat from top",
      picked="select *, in_cat <= 1 and sum((in_cat <= 1)::int) over (order by rank) <= 5 as pick from cat",
      slotted="select *, row_number() over (order by pick desc, rank) as slot from picked") + """
    select item_id, label, row_number() over (order by rank) as place, (select count(*) from hit) as total from slotted where slot <= 5""")
def top11(spark, sf):
    """Five varied rows of a filtered catalogue and the number of matches."""
    hit = b.items(spark, sf).where((F.col("difficulty") == "beginner") & F.col("tempo").between(100, 130)).select(
        "item_id", "label", F.abs(F.col("tempo") - 115).alias("gap"))
    # Of a label no row beyond its first six can be picked: one under the cap, five to fill. The report is one key.
    by_label = Window.partitionBy("label").orderBy("gap", "item_id")
    few = hit.withColumn("place", F.row_number().over(by_label)).where("place <= 6").drop("place")
    ranked = few.withColumn("one", F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy("gap", "item_id")))
    return capped_topk(ranked, "one", "label", 5).select("item_id", "label", "place", hit.agg(F.count(F.lit(1))).scalar().alias("total"))


# --- compatibility graph ------------------------------------------------------------------

@query("jon4_compatibility_degree", b.with_("items") + f"""
    select a.item_id, count(*) as n_compatible from items a join items c on a.item_id <> c.item_id and {COMPAT_SQL} group by 1""")
def jon4(spark, sf):
    return graph.degrees(b.items(spark, sf), "item_id").select("item_id", "n_compatible")


@query("jon4_class_edges", b.with_("items", k="select label, difficulty, energy, count(*) as n from items group by 1, 2, 3") + f"""
    select a.label, a.difficulty, a.energy, c.label as to_label, c.difficulty as to_difficulty, c.energy as to_energy, a.n as from_n, c.n as to_n
    from k a join k c on {COMPAT_SQL}""")
def jon4_edges(spark, sf):
    return graph.class_edges(b.items(spark, sf))
