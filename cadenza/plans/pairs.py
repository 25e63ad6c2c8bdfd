"""Pair similarities, transitions, training data and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, scores, vectors, vocab
from ..operators import experiments as ex
from ..operators import nearest as nn
from ..operators.keyed import MotionEnds, MotionStep, keyed_best, keyed_stats
from ..operators.ordering import dense_index
from ..operators.profiles import rounded, spread
from ..session import written
from . import binding as b
from .registry import query
from .scoring import PAIRS, TOPK_SQL, WHOLE, known, pair_attributes, pair_cosines

RANK = b.sql_rank
NEIGHBOURS = 4  # each item is compared with the next four


def _in(words):
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


# --- neighbours in id order ------------------------------------------------------------

NB = dict(ranked="select *, row_number() over (order by item_id) - 1 as i from motion",
          pairs="select a.item_id as a_id, c.item_id as b_id, a as a, c as c from ranked a join ranked c on c.i between a.i + 1 and a.i + 4")


def neighbour_pairs(df, columns):
    """Each row with the next four in id order, both sides prefixed; an equi-join on the position."""
    idx = dense_index(df.select("item_id", *columns), [], ["item_id"], F.floor(F.col("item_id") / 1_000_000), name="i")
    a = idx.select(*[F.col(c).alias(f"a_{c}") for c in ["item_id", *columns]],
                   F.explode(F.sequence(F.col("i") + 1, F.col("i") + NEIGHBOURS)).alias("i"))
    c = idx.select(*[F.col(x).alias(f"b_{x}") for x in ["item_id", *columns]], "i")
    return a.join(c, "i").drop("i")


def motion(spark, sf):
    return b.motion(b.item_vectors(spark, sf))


@query("jon6_sliding_neighbours", b.with_("items", r="select item_id, row_number() over (order by item_id) - 1 as i from items") + """
    select a.item_id as a_item_id, c.item_id as b_item_id from r a join r c on c.i between a.i + 1 and a.i + 4""")
def jon6(spark, sf):
    return neighbour_pairs(b.items(spark, sf), []).select("a_item_id", "b_item_id")


def _label_sim_sql(x, y):
    whens = " ".join(f"when ({x} = '{p}' and {y} = '{q}') or ({x} = '{q}' and {y} = '{p}') then {s}" for p, q, s in vocab.LABEL_SIMILARITY)
    return f"(case when {x} = {y} then 1.0 {whens} else 0.1 end)::double"


ORD = "greatest(0.0, 1.0 - abs({a} - {b}) * 0.5)::double"
D_SIM, E_SIM = ORD.format(a="a.difficulty_rank", b="c.difficulty_rank"), ORD.format(a="a.energy_rank", b="c.energy_rank")
T_SIM = "exp(-power(a.tempo - c.tempo, 2) / 450.0)"
L_SIM = _label_sim_sql("a.label", "c.label")


@query("prj37_label_similarity", b.with_("motion", **NB) + f"select a_id, b_id, {L_SIM} as similarity from pairs")
def prj37(spark, sf):
    p = neighbour_pairs(b.items(spark, sf), ["label"])
    return p.select(F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id"),
                    scores.label_similarity(F.col("a_label"), F.col("b_label")).alias("similarity"))


@query("prj38_ordinal_gaussian", b.with_("motion", **NB) + f"select a_id, b_id, {D_SIM} as difficulty, {E_SIM} as energy, round({T_SIM}, 6) as tempo from pairs")
def prj38(spark, sf):
    p = neighbour_pairs(b.items(spark, sf), ["difficulty", "energy", "tempo"])
    return p.select(
        F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id"),
        scores.ordinal_similarity(F.col("a_difficulty"), F.col("b_difficulty")).alias("difficulty"),
        scores.ordinal_similarity(F.col("a_energy"), F.col("b_energy")).alias("energy"),
        F.round(scores.gaussian_similarity(F.col("a_tempo"), F.col("b_tempo")), 6).alias("tempo"))


TRANSITION_SQL = """0.25 * (""" + " + ".join(f"greatest(0, 1 - abs(a.end_{j} - c.start_{j}) / 180)" for j in range(4)) + """) / 4
    + 0.35 * (0.4 * greatest(0, 1 - abs(a.speed_end - c.speed_start) * 10) + 0.3 * (case when a.direction = c.direction then 1.0 else 0.7 end)
      + 0.3 * greatest(0, 1 - abs(a.coverage - c.coverage) * 5))
    + 0.25 * (case abs(a.energy_rank - c.energy_rank) when 0 then 1.0 when 1 then 0.8 else 0.4 end)
    + 0.15 * (case c.difficulty_rank - a.difficulty_rank when 0 then 1.0 when 1 then 0.9 when -1 then 0.7 when 2 then 0.5 else 0.3 end)"""
TRANSITION_COLS = [*[f"start_{j}" for j in range(4)], *[f"end_{j}" for j in range(4)], "speed_start", "speed_end", "coverage", "direction",
                   "energy_rank", "difficulty_rank"]


def transition_parts(a="a_", c="b_"):
    f = F.col
    return {
        "pose": scores.pose_transition([f(f"{a}end_{j}") for j in range(4)], [f(f"{c}start_{j}") for j in range(4)]),
        "flow": scores.movement_flow(f(f"{a}speed_end"), f(f"{c}speed_start"), f(f"{a}direction"), f(f"{c}direction"), f(f"{a}coverage"), f(f"{c}coverage")),
        "energy": scores.ladder(f(f"{a}energy"), f(f"{c}energy"), near=0.8, far=0.4),
        "difficulty": scores.step_score(f(f"{a}difficulty"), f(f"{c}difficulty")),
    }


@query("prj42_transition_parts", b.with_("motion", **NB, t=f"select a_id, b_id, {TRANSITION_SQL} as score from pairs") + """
    select a_id, b_id, round(score, 6) as score, score > 0.7 as is_smooth, score < 0.4 as requires_pause,
      case when score > 0.7 then 0.5 when score < 0.4 then 2.0 else 1.0 end::double as seconds from t""")
def prj42(spark, sf):
    p = neighbour_pairs(motion(spark, sf), [*TRANSITION_COLS, "energy", "difficulty"])
    s = p.select(F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id"), scores.weighted(transition_parts(), vocab.TRANSITION_WEIGHTS).alias("score"))
    return s.withColumn("w", scores.transition_flags(F.col("score"))).select("a_id", "b_id", F.round("score", 6).alias("score"), "w.*")


@query("prj43_pose_direction_compatibility", b.with_("motion", **NB) + """
    select a_id, b_id, round(0.8 * (""" + " + ".join(f"greatest(0, 1 - abs(a.end_{j} - c.start_{j}) / 180)" for j in range(4))
       + """ + greatest(0, 1 - abs(a.coverage - c.coverage) * 90 / 180)) / 5
      + 0.2 / (1 + 10 * sqrt(power(a.cx - c.cx, 2) + power(a.cy - c.cy, 2))), 6) as pose,
      case when a.direction = c.direction then 1.0 when a.direction < 2 and c.direction < 2 then 0.8 when a.direction >= 2 and c.direction >= 2 then 0.6 else 0.5 end::double as heading
    from pairs""")
def prj43(spark, sf):
    p = neighbour_pairs(motion(spark, sf), [*TRANSITION_COLS, "cx", "cy"])
    names = ["horizontal", "horizontal_left", "vertical_up", "vertical_down"]
    lean = [F.col("a_coverage") * 90], [F.col("b_coverage") * 90]
    angles = scores.pose_transition([F.col(f"a_end_{j}") for j in range(4)] + lean[0], [F.col(f"b_start_{j}") for j in range(4)] + lean[1])
    away = F.sqrt(F.pow(F.col("a_cx") - F.col("b_cx"), 2.0) + F.pow(F.col("a_cy") - F.col("b_cy"), 2.0))
    return p.select(
        F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id"),
        F.round(angles * 0.8 + 0.2 / (1.0 + away * 10), 6).alias("pose"),
        scores.direction_compat(b.pick(names, F.col("a_direction")), b.pick(names, F.col("b_direction"))).alias("heading"))


# --- whole-matrix operators, in blocks -----------------------------------------------------

@query("jon2_similar_pairs", b.with_("vecs") + """
    select a.vec_id as a, c.vec_id as b, round(round(list_cosine_similarity(a.vec, c.vec), 9), 6) as cosine
    from vecs a join vecs c on a.vec_id < c.vec_id where round(list_cosine_similarity(a.vec, c.vec), 9) >= 0.3""")
def jon2(spark, sf):
    """Upper triangle of the similarity matrix above a threshold; the diagonal is 1 and the rest mirrors it."""
    n = b.table(spark, sf, "embeddings").count()
    return nn.block_pairs(b.vectors(spark, sf).select("vec_id", "vec"), "vec_id", 0.3, size=n).select("a", "b", F.round("score", 6).alias("cosine"))


#: What the motion of an item depends on: items that agree on these are one class.
MOVES = ["vec_id", "direction", "energy_rank", "difficulty_rank"]


def motion_keys(spark, sf):
    return b.item_keys(spark, sf).select(
        "item_id", "vec_id", (F.col("item_id") % 4).alias("direction"),
        scores.level_rank(F.col("energy")).alias("energy_rank"), scores.level_rank(F.col("difficulty")).alias("difficulty_rank"))


def motion_ends(spark, sf):
    """(key, feat) of the end of each vector's motion, and of its start."""
    v = b.poses(b.vectors(spark, sf).withColumnRenamed("vec_id", "key"))
    return [v.select("key", F.array(*[f"{at}_{j}" for j in range(4)], f"speed_{at}", "coverage").alias("feat")) for at in ("end", "start")]


@query("jon3_best_transitions", b.with_("motion", scored=f"select a.item_id as req_id, c.item_id, round({TRANSITION_SQL}, 9) as score from motion a join motion c on a.item_id <> c.item_id") + f"""
    select req_id as item_id, item_id as next_id, round(score, 6) as score, rank from ({TOPK_SQL.format(src='scored')}) where rank <= 3""")
def jon3(spark, sf):
    """Four are searched for each item by the motions of the vectors, the item itself is left out of its own."""
    keys = motion_keys(spark, sf).withColumnRenamed("vec_id", "key")
    ends, starts = motion_ends(spark, sf)
    n, n_vec = b.table(spark, sf, "part").count(), b.table(spark, sf, "embeddings").count()
    near = keyed_best(keys, keys.withColumnRenamed("item_id", "next_id"), ends, starts, "item_id", "next_id", 4,
                      MotionEnds(vocab.TRANSITION_WEIGHTS), MotionStep(vocab.TRANSITION_WEIGHTS), MOVES[1:], (n, n, n_vec))
    rest = F.filter("best", lambda x: x["next_id"] != F.col("item_id"))
    best = near.select("item_id", F.posexplode(F.slice(rest, 1, 3)).alias("at", "x"))
    return best.select("item_id", "x.next_id", F.round(-F.col("x.neg"), 6).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


@query("agg19_transition_summary", b.with_("motion", scored=f"select {TRANSITION_SQL} as score from motion a join motion c on a.item_id <> c.item_id") + """
    select count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(min(score), 6) as min, round(max(score), 6) as max,
      count(*) filter (score > 0.7) as smooth, count(*) filter (score < 0.4) as pause,
      round(100.0 * count(*) filter (score > 0.7) / count(*), 6) as smooth_pct from scored""")
def agg19(spark, sf):
    """Pairs of motion classes, weighted by their sizes; what hangs on the vectors is worked out once for two of them."""
    classes = written(motion_keys(spark, sf).withColumnRenamed("vec_id", "key").groupBy("key", *MOVES[1:]).agg(F.count(F.lit(1)).alias("n")), "motions")
    inf = float("inf")
    s = keyed_stats(classes, *motion_ends(spark, sf), classes.count(), b.table(spark, sf, "embeddings").count(), MotionEnds(vocab.TRANSITION_WEIGHTS),
                    MotionStep(vocab.TRANSITION_WEIGHTS), MOVES[1:], {"smooth": (0.7, inf), "pause": (-inf, 0.4)})
    return rounded(s.withColumn("smooth_pct", F.try_divide(F.col("smooth") * 100.0, F.col("n"))))


def _codes():
    """Square similarity table of the label vocabulary."""
    lookup = {(x, y): s for x, y, s in vocab.LABEL_SIMILARITY}
    return [[1.0 if x == y else lookup.get((x, y), lookup.get((y, x), 0.1)) for y in vocab.LABELS] for x in vocab.LABELS]


def truth_scorers():
    parts = {"label": nn.LabelTable(_codes()), "difficulty": nn.Ordinal("difficulty_rank"), "energy": nn.Ordinal("energy_rank"), "tempo": nn.Gaussian("tempo")}
    parts["overall"] = nn.Blend([(0.4, parts["label"]), (0.2, parts["difficulty"]), (0.2, parts["energy"]), (0.2, parts["tempo"])])
    return parts


def coded_items(spark, sf):
    code = F.array_position(F.array(*[F.lit(x) for x in vocab.LABELS]), F.col("label")) - 1
    return b.items(spark, sf).select(
        "item_id", code.alias("label_code"), scores.level_rank(F.col("difficulty")).alias("difficulty_rank"),
        scores.level_rank(F.col("energy")).alias("energy_rank"), F.col("tempo").cast("double").alias("tempo"))


SIMS_SQL = dict(sims=f"""select a.item_id as a, c.item_id as b, {L_SIM} as label, {D_SIM} as difficulty, {E_SIM} as energy, {T_SIM} as tempo
    from motion a join motion c on a.item_id < c.item_id""",
    long=" union all ".join(f"select '{n}' as name, a, b, {e} as s from sims" for n, e in
                            [(x, x) for x in ("label", "difficulty", "energy", "tempo")] + [("overall", "0.4 * label + 0.2 * difficulty + 0.2 * energy + 0.2 * tempo")]))


@query("jon5_truth_matrices", b.with_("motion", **SIMS_SQL) + """
    select name, count(*) as n_pairs, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std from long group by name""")
def jon5(spark, sf):
    """All pairs stand for pairs of attribute classes, weighted by their sizes."""
    attrs = ["label_code", "difficulty_rank", "energy_rank", "tempo"]
    classes = coded_items(spark, sf).groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("class_id"))
    return rounded(nn.class_pair_stats(classes, "class_id", "n", truth_scorers()))


HASH_SQL = "((a % 2147483647) * 1103515245 + (b % 2147483647) * 12345677 + 5) % 2147483647"


@query("top12_balanced_pairs", b.with_("motion", **SIMS_SQL,
      classed="select *, case when round(s, 9) >= 0.7 then 'positive' else 'negative' end as class from long where round(s, 9) >= 0.7 or round(s, 9) <= 0.3",
      placed=f"select *, row_number() over (partition by name, class order by {HASH_SQL}, a, b) as place, count(*) over (partition by name, class) as total from classed",
      caps="select name, case when count(distinct class) < 2 then 0 else least(min(total), 50) end as cap from placed group by 1") + """
    select name, class, a, b, round(s, 6) as similarity from placed join caps using (name) where place <= cap""")
def top12(spark, sf):
    n = b.table(spark, sf, "part").count()
    return nn.balanced_pair_sample(coded_items(spark, sf), "item_id", truth_scorers(), 0.7, 0.3, 50, seed=5, size=n).select(
        "name", "class", "a", "b", F.round("similarity", 6).alias("similarity"))


MIX = dict(u="select vec_id, vec, vec[1:16] as p, vec[17:64] as q from vecs",
           s="""select 0.4 * list_cosine_similarity(a.p, c.p) + 0.4 * list_cosine_similarity(a.q, c.q) + 0.2 * list_cosine_similarity(a.vec, c.vec) as s
             from u a join u c on a.vec_id < c.vec_id""")


@query("agg15_collection_quality", b.with_("vecs", **MIX, d="select i, stddev_pop(vec[i]) as sd, var_pop(vec[i]) as vr from vecs, (select unnest(range(1, 65)) as i) group by i",
      m="select list_sum(p) / 16 as x, list_sum(q) / 48 as y from u") + """
    select count(*) as n, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, round(min(s), 6) as min, round(max(s), 6) as max,
      (select round(avg((sd > 1e-6)::int), 6) from d) as used_dims, (select round(avg(vr), 6) from d) as mean_variance,
      (select round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) from m) as part_correlation from s""")
def agg15(spark, sf):
    """Part cosines become one dot product of weighted unit parts, so the whole mix is one block product."""
    v = b.vectors(spark, sf)
    p, q = F.slice("vec", 1, 16), F.slice("vec", 17, 48)
    mixed = F.concat(vectors.scaled(vectors.l2_normalize(p), 0.4**0.5), vectors.scaled(vectors.l2_normalize(q), 0.4**0.5),
                     vectors.scaled(vectors.l2_normalize(F.col("vec")), 0.2**0.5))
    n = b.table(spark, sf, "embeddings").count()
    stats = nn.block_stats(v.select("vec_id", mixed.alias("vec")), "vec_id", unit=False, sizes=(n, n))
    dims = v.agg(*[F.var_pop(F.get("vec", i)).alias(f"d{i}") for i in range(64)])
    var = F.array(*[F.col(f"d{i}") for i in range(64)])
    per_dim = dims.select(
        vectors.vec_mean(F.transform(var, lambda x: F.when(F.sqrt(x) > 1e-6, 1.0).otherwise(0.0))).alias("u"), vectors.vec_mean(var).alias("m"))
    parts = v.select(vectors.vec_mean(p).alias("x"), vectors.vec_mean(q).alias("y")).agg(
        F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0)))
    return rounded(stats.select(
        "*", per_dim.select("u").scalar().alias("used_dims"), per_dim.select("m").scalar().alias("mean_variance"), parts.scalar().alias("part_correlation")))


@query("win25_fused_similarity", b.with_("item_vectors", "request_vectors", **PAIRS) + """
    select l_orderkey, l_linenumber, item_id, round(0.4 * list_cosine_similarity(r.vec[1:16], i.vec[1:16]) + 0.4 * list_cosine_similarity(r.vec[17:64], i.vec[17:64])
      + 0.2 * list_cosine_similarity(r.vec, i.vec), 6) as similarity from purchases p join request_vectors r using (req_id) join item_vectors i using (item_id)""")
def win25(spark, sf):
    p = pair_cosines(spark, sf, first=(0, 16), rest=(16, 48), cosine=WHOLE)
    mix = known("first") * 0.4 + known("rest") * 0.4 + known("cosine") * 0.2
    return p.select("l_orderkey", "l_linenumber", "item_id", F.round(mix, 6).alias("similarity"))


# --- training set ----------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg13_dataset_statistics", " union all ".join(
    f"select '{c}' as feature, count(*) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, min({c}) as min, max({c}) as max from lineitem" for c in FEATURES)
    + " union all select 'vector_norm', count(*), round(avg(x), 6), round(stddev_pop(x), 6), round(min(x), 6), round(max(x), 6) from (select sqrt(list_sum([y * y for y in embedding::double[]])) as x from embeddings)")
def agg13(spark, sf):
    li = b.table(spark, sf, "lineitem").select(*FEATURES)
    long = li.unpivot([], FEATURES, "feature", "value")
    norms = b.vectors(spark, sf).select(F.lit("vector_norm").alias("feature"), vectors.norm(F.col("vec")).alias("value"))
    return rounded(long.unionByName(norms).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *spread("value")))


@query("agg13_quality_bands", """select case when n_chars >= 5000 then 'high' when n_chars >= 1000 then 'medium' else 'low' end as band, count(*) as n,
      round(avg(n_chars), 6) as mean_chars from documents group by 1""")
def agg13_bands(spark, sf):
    n = F.col("n_chars")
    band = F.when(n >= 5000, "high").when(n >= 1000, "medium").otherwise("low")
    return b.table(spark, sf, "documents").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_chars"))


@query("agg14_dataset_validity", b.with_("vecs", d="select i, var_pop(vec[i]) as vr from vecs, (select unnest(range(1, 65)) as i) group by i") + """
    select *, round((complete::int + same_dimension::int + no_nan::int + no_inf::int + has_variance::int + has_positive::int + has_negative::int + balanced::int) / 8.0, 6) as score from (
      select bool_and(vec is not null and len(vec) > 0) as complete, count(distinct len(vec)) = 1 as same_dimension, true as no_nan, true as no_inf,
        (select avg(vr) > 1e-6 from d) as has_variance, bool_or(vec_label >= 7) as has_positive, bool_or(vec_label <= 3) as has_negative,
        abs(count(*) filter (vec_label >= 7) - count(*) filter (vec_label <= 3)) < 0.2 * count(*) as balanced from vecs)""")
def agg14(spark, sf):
    v, x = b.vectors(spark, sf), F.col("vec")
    pos, neg = F.col("vec_label") >= 7, F.col("vec_label") <= 3
    dims = v.agg(*[F.var_pop(F.get("vec", i)).alias(f"d{i}") for i in range(64)])
    var = dims.select(vectors.vec_mean(F.array(*[F.col(f"d{i}") for i in range(64)])) > 1e-6).scalar()
    flags = v.agg(
        F.every(x.isNotNull() & (F.size(x) > 0)).alias("complete"), (F.count_distinct(F.size(x)) == 1).alias("same_dimension"),
        F.every(~F.exists(x, lambda e: F.isnan(e))).alias("no_nan"),
        F.every(~F.exists(x, lambda e: F.abs(e) == float("inf"))).alias("no_inf"),
        F.some(pos).alias("has_positive"), F.some(neg).alias("has_negative"),
        (F.abs(F.count_if(pos) - F.count_if(neg)) < F.count(F.lit(1)) * 0.2).alias("balanced")).withColumn("has_variance", var)
    names = ["complete", "same_dimension", "no_nan", "no_inf", "has_variance", "has_positive", "has_negative", "balanced"]
    return flags.withColumn("score", F.round(sum((F.col(c).cast("int") for c in names[1:]), F.col(names[0]).cast("int")) / len(names), 6))


@query("src15_label_matrix", b.with_("items", k="select label, count(*) as n from items group by 1") + "select label, " + ", ".join(
    f"max(case when o = '{x}' then s end) as {x}" for x in vocab.LABELS) + f" from (select a.label, c.label as o, round({_label_sim_sql('a.label', 'c.label')} * c.n, 6) as s from k a, k c) group by label")
def src15(spark, sf):
    """Wide square table for export: label similarity times the rows of the column label."""
    k = b.items(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    long = k.select(F.explode(F.array(*[F.lit(x) for x in vocab.LABELS])).alias("a"), F.col("label").alias("o"), "n").join(
        k.select(F.col("label").alias("a")), "a")
    sim = F.round(scores.label_similarity(F.col("a"), F.col("o")) * F.col("n"), 6)
    return long.withColumn("s", sim).groupBy(F.col("a").alias("label")).pivot("o", vocab.LABELS).agg(F.first("s"))


# --- experiments -----------------------------------------------------------------------------

EXAMPLES = dict(ex=f"""select item_id, label, tempo, difficulty, energy, difficulty_rank, energy_rank,
    least(1.0, case difficulty when 'beginner' then 0.3 when 'intermediate' then 0.6 else 0.9 end + case when {' or '.join(f"contains(label, '{w}')" for w in vocab.COMPLEX_LABELS)} then 0.2 else 0 end)::double as complexity,
    case when {' or '.join(f"contains(label, '{w}')" for w in vocab.RHYTHMIC_LABELS)} then 0.8 else 0.6 end::double as rhythm,
    [tempo / 130.0, e, tempo / 130.0 * e]::double[] as feat from (select *, case energy when 'low' then 0.3 when 'medium' then 0.6 else 0.9 end as e from motion)""")


def examples(spark, sf):
    """Validation examples derived from the annotations (no noise)."""
    level = F.when(F.col("energy") == "low", 0.3).when(F.col("energy") == "medium", 0.6).otherwise(0.9)
    base = F.when(F.col("difficulty") == "beginner", 0.3).when(F.col("difficulty") == "intermediate", 0.6).otherwise(0.9)
    extra = F.when(labels.any_of(F.col("label"), vocab.COMPLEX_LABELS), 0.2).otherwise(0.0)
    pace = F.col("tempo") / 130.0
    return b.items(spark, sf).select(
        "item_id", "label", "tempo", "difficulty", "energy", F.least(F.lit(1.0), base + extra).alias("complexity"),
        F.when(labels.any_of(F.col("label"), vocab.RHYTHMIC_LABELS), 0.8).otherwise(0.6).alias("rhythm"),
        F.array(pace, level, pace * level).alias("feat"))


@query("evl9_derived_examples", b.with_("motion", **EXAMPLES) + "select item_id, round(complexity, 6) as complexity, rhythm, round(feat[1], 6) as f0, feat[2] as f1, round(feat[3], 6) as f2 from ex")
def evl9(spark, sf):
    return rounded(examples(spark, sf).select("item_id", "complexity", "rhythm", *[F.get("feat", i).alias(f"f{i}") for i in range(3)]))


EVAL_PAIRS = dict(**EXAMPLES, rex="select *, row_number() over (order by item_id) - 1 as i from ex",
    pp="""select a.item_id as a_id, c.item_id as b_id, a.i, greatest(0, list_cosine_similarity(a.feat, c.feat)) as p_audio, exp(-power(a.tempo - c.tempo, 2) / 450.0) as p_tempo,
      1 - abs(a.energy_rank - c.energy_rank) / 2 as p_energy, 1 - abs(a.difficulty_rank - c.difficulty_rank) / 2 as p_difficulty,
      greatest(0.0, least(1.0, case when a.label = c.label then 0.8 when """ + " or ".join(f"(a.label = '{x}' and c.label = '{y}')" for x, y in vocab.RELATED_LABELS) + """ then 0.6 else 0.2 end
        + (a.difficulty = c.difficulty)::int * 0.1 + (a.energy = c.energy)::int * 0.1 + case when abs(a.tempo - c.tempo) < 10 then 0.1 when abs(a.tempo - c.tempo) > 30 then -0.1 else 0 end))::double as truth
      from rex a join rex c on c.i between a.i + 1 and a.i + 4""")


def eval_pairs(spark, sf):
    p = neighbour_pairs(examples(spark, sf), ["label", "tempo", "difficulty", "energy", "feat"])
    c = F.col
    return p.select(
        c("a_item_id").alias("a_id"), c("b_item_id").alias("b_id"),
        F.greatest(F.lit(0.0), vectors.cosine(c("a_feat"), c("b_feat"))).alias("p_audio"),
        scores.gaussian_similarity(c("a_tempo"), c("b_tempo")).alias("p_tempo"),
        (1.0 - scores.level_gap(c("a_energy"), c("b_energy")) / 2.0).alias("p_energy"),
        (1.0 - scores.level_gap(c("a_difficulty"), c("b_difficulty")) / 2.0).alias("p_difficulty"),
        scores.rule_truth(c("a_label"), c("b_label"), c("a_difficulty"), c("b_difficulty"), c("a_energy"), c("b_energy"), c("a_tempo"), c("b_tempo")).alias("truth"))


PARTS = list(vocab.SCORE_WEIGHTS)


def parts():
    return {k: F.col(f"p_{k}") for k in PARTS}


@query("evl1_weighted_similarity", b.with_("motion", **EVAL_PAIRS) + "select a_id, b_id, round(0.4 * p_audio + 0.3 * p_tempo + 0.2 * p_energy + 0.1 * p_difficulty, 6) as similarity from pp")
def evl1(spark, sf):
    return eval_pairs(spark, sf).select("a_id", "b_id", F.round(scores.weighted(parts(), vocab.SCORE_WEIGHTS), 6).alias("similarity"))


@query("evl2_rule_truth", b.with_("motion", **EVAL_PAIRS) + "select a_id, b_id, round(truth, 6) as truth from pp")
def evl2(spark, sf):
    return rounded(eval_pairs(spark, sf).select("a_id", "b_id", "truth"))


GRID = dict(g="""select i as config, 0.1 + (i // 125) % 5 * 0.5 / 4 as wa, 0.1 + (i // 25) % 5 * 0.3 / 4 as wt, 0.1 + (i // 5) % 5 * 0.3 / 4 as we, 0.1 + i % 5 * 0.3 / 4 as wd
      from (select unnest(range(625)) as i) order by md5('0:' || i) limit 100""",
    gw="select config, wa / (wa + wt + we + wd) as wa, wt / (wa + wt + we + wd) as wt, we / (wa + wt + we + wd) as we, wd / (wa + wt + we + wd) as wd from g")
GRID_SCORES = dict(gs="""select config, avg(1 - abs(wa * p_audio + wt * p_tempo + we * p_energy + wd * p_difficulty - truth)) as score from pp, gw group by config""")


def grid_scores(spark, sf):
    """Mean agreement with the truth per configuration, one aggregation over pairs x configurations."""
    p = ex.with_configs(eval_pairs(spark, sf), ex.grid_ids())
    similar = scores.weighted(parts(), ex.grid_weights(F.col("config")))
    return p.groupBy("config").agg(F.avg(1.0 - F.abs(similar - F.col("truth"))).alias("score"))


@query("evl3_grid_evaluation", b.with_("motion", **EVAL_PAIRS, **GRID, **GRID_SCORES) + "select config::int as config, round(score, 6) as score from gs")
def evl3(spark, sf):
    return rounded(grid_scores(spark, sf))


@query("evl4_search_statistics", b.with_("motion", **EVAL_PAIRS, **GRID, **GRID_SCORES) + """
    select count(*) as n, round(max(score), 6) as best, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(min(score), 6) as worst,
      round(quantile_cont(score, 0.9), 6) as p90 from gs""")
def evl4(spark, sf):
    # At most 100 configurations reach this aggregate.
    return rounded(grid_scores(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.min("score").alias("worst"), F.percentile("score", 0.9).alias("p90")))


@query("top13_capped_grid", b.with_("motion", **EVAL_PAIRS, **GRID) + """
    select config::int as config, round(wa, 6) as w_audio, round(wt, 6) as w_tempo, round(we, 6) as w_energy, round(wd, 6) as w_difficulty,
      round(wa * (select avg(p_audio) from pp) + wt * (select avg(p_tempo) from pp) + we * (select avg(p_energy) from pp) + wd * (select avg(p_difficulty) from pp), 6) as mean_similarity from gw""")
def top13(spark, sf):
    """The chosen configurations; the score is linear in the weights, so part means are enough."""
    means = eval_pairs(spark, sf).agg(*[F.avg(f"p_{k}").alias(f"p_{k}") for k in PARTS])
    w = ex.grid_weights(F.col("config"))
    return rounded(ex.with_configs(means, ex.grid_ids()).select(
        "config", *[w[k].alias(f"w_{k}") for k in PARTS], scores.weighted(parts(), w).alias("mean_similarity")))


@query("top14_best_configuration", b.with_("motion", **EVAL_PAIRS, **GRID, **GRID_SCORES) + """
    select (select config from gs order by round(score, 9) desc, config limit 1)::int as best_config, round(max(score), 6) as best_score,
      (select config from gs order by round(score, 9), config desc limit 1)::int as worst_config from gs""")
def top14(spark, sf):
    s = F.round("score", 9)
    return rounded(grid_scores(spark, sf).agg(
        F.max_by("config", F.struct(s, -F.col("config"))).alias("best_config"), F.max("score").alias("best_score"),
        F.min_by("config", F.struct(s, -F.col("config"))).alias("worst_config")))


FOLDS = dict(f="select complexity, least((row_number() over (order by item_id) - 1) // greatest((select count(*) from ex) // 3, 1), 2)::int as fold from ex",
             fs="select fold, count(*) as n, avg(complexity) as score from f group by fold")


@query("evl5_contiguous_folds", b.with_("motion", **EXAMPLES, **FOLDS) + """
    select fold, n, round(score, 6) as score, (select round(avg(score), 6) from fs) as mean,
      (select round(avg(score) - 1.96 * stddev_pop(score) / sqrt(3), 6) from fs) as ci_low from fs""")
def evl5(spark, sf):
    k = 3
    folds = ex.contiguous_folds(examples(spark, sf).select("item_id", "complexity"), ["item_id"], F.floor(F.col("item_id") / 1_000_000), k)
    per = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("complexity").alias("score"))
    mean = per.agg(F.avg("score")).scalar()
    low = per.agg(F.avg("score") - F.stddev_pop("score") * 1.96 / k**0.5).scalar()
    return rounded(per.withColumn("mean", mean).withColumn("ci_low", low))


@query("evl6_traffic_assignment", """
    select case when bucket < 50 then 'control' when bucket < 80 then 'variant' when bucket < 90 then 'test' else 'control' end as version, count(*) as n, min(c_custkey) as first_user
    from (select c_custkey, ('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint % 100 as bucket from customer) group by 1""")
def evl6(spark, sf):
    v = ex.assign_version(F.col("c_custkey"), [("control", 50), ("variant", 30), ("test", 10)])
    return b.table(spark, sf, "customer").groupBy(v.alias("version")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_user"))


@query("evl7_paired_variant_test", b.with_("requests", "items", **PAIRS, per=f"""
      select req_id, avg(0.6 * t + 0.2 * e + 0.2 * d) as a, avg(0.2 * t + 0.4 * e + 0.4 * d) as c from (select req_id, exp(-power(r.tempo - i.tempo, 2) / 450.0) as t,
        1 - abs({RANK('r.energy')} - {RANK('i.energy')}) / 2 as e, 1 - abs({RANK('r.difficulty')} - {RANK('i.difficulty')}) / 2 as d
        from purchases p join requests r using (req_id) join items i using (item_id)) group by 1""",
      m="select count(*) as n, avg(a) as mean_a, avg(c) as mean_b, sqrt((var_pop(a) + var_pop(c)) / 2) as pooled_std from per",
      t="select *, (mean_b - mean_a) / mean_a * 100 as improvement, abs(mean_b - mean_a) / (pooled_std * sqrt(2.0 / n)) as t from m") + """
    select n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(pooled_std, 6) as pooled_std, round(improvement, 6) as improvement, round(t, 6) as t,
      round(greatest(0, least(1, 1 - t / 4)), 6)::double as significance_proxy from t""")
def evl7(spark, sf):
    p = pair_attributes(spark, sf)
    c = F.col
    t = scores.gaussian_similarity(c("r_tempo"), c("i_tempo"))
    e = 1.0 - scores.level_gap(c("r_energy"), c("i_energy")) / 2.0
    d = 1.0 - scores.level_gap(c("r_difficulty"), c("i_difficulty")) / 2.0
    per = p.groupBy("req_id").agg(F.avg(t * 0.6 + e * 0.2 + d * 0.2).alias("a"), F.avg(t * 0.2 + e * 0.4 + d * 0.4).alias("b"))
    return rounded(ex.paired_test(per, "a", "b"))
