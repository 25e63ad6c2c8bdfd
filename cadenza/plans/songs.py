"""Beats, onsets, sections and feature vectors of songs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music, scores, vectors, vocab
from ..operators import clip_features as cf
from ..operators import intervals as iv
from ..operators import series as s
from ..operators import song_features as sf_
from ..operators.ordering import dense_index, with_neighbours
from ..operators.profiles import rounded
from . import binding as b
from .registry import query
from .series import K
from .series import beats as song_beats

HOUR = 3600.0
BEAT = dict(beats="select user_id, t, event_id, row_number() over (partition by user_id order by t, event_id) - 1 as i, count(*) over (partition by user_id) as n from ev where event_type in ('view', 'click')",
            onsets="select user_id, t, event_id, value from ev where event_type = 'purchase'")


def beats(spark, sf):
    e = b.events(spark, sf).where(F.col("event_type").isin("view", "click")).select("user_id", "t", "event_id")
    return dense_index(e, ["user_id"], ["t", "event_id"], F.floor(F.col("t") / 60), name="i")


def onsets(spark, sf):
    return b.events(spark, sf).where("event_type = 'purchase'").select("user_id", "t", "event_id", "value")


NEAR = dict(**BEAT, near="select o.user_id, o.event_id, min(abs(o.t - p.t)) as gap, arg_min(p.i, (abs(o.t - p.t), p.i)) as beat from onsets o join beats p using (user_id) group by 1, 2")


def nearest_beats(spark, sf):
    return iv.nearest(onsets(spark, sf), beats(spark, sf).select("user_id", "t", "i"), ["user_id"], "t", b.day_of, ["i"])


@query("jon8_nearest_in_time", b.with_("ev", **NEAR) + "select event_id, beat, round(gap, 4) as gap from near")
def jon8(spark, sf):
    return nearest_beats(spark, sf).where("nearest is not null").select("event_id", F.col("nearest.i").alias("beat"), F.round("gap", 4).alias("gap"))


@query("jon9_off_beat_ratio", b.with_("ev", **NEAR) + f"select user_id, count(*) as n, round(avg((gap > {4 * HOUR})::int), 6) as off_beat from near group by 1")
def jon9(spark, sf):
    near = nearest_beats(spark, sf).where("nearest is not null")
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gap") > 4 * HOUR).cast("int")), 6).alias("off_beat"))


@query("jon10_anticipation", b.with_("ev", **BEAT) + f"""
    select user_id, count(*) as n, round(avg(exists(select 1 from onsets o where o.user_id = beats.user_id and o.t > beats.t - {12 * HOUR} and o.t < beats.t - {HOUR})::int), 6) as anticipated
    from beats group by user_id""")
def jon10(spark, sf):
    """A beat is anticipated when the last onset before b - 1h lies after b - 12h: no pairs are built."""
    probes = beats(spark, sf).withColumn("beat_t", F.col("t")).withColumn("t", F.col("t") - HOUR - 1e-6)
    found = iv.last_and_first(probes, onsets(spark, sf).select("user_id", "t"), ["user_id"], "t", b.day_of, [])
    hit = F.coalesce(F.col("before.t") > F.col("beat_t") - 12 * HOUR, F.lit(False))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("anticipated"))


@query("jon11_weak_beats", b.with_("ev", **BEAT) + f"""
    select user_id, round(coalesce(sum((i % 4 in (1, 3) and exists(select 1 from onsets o where o.user_id = beats.user_id and abs(o.t - beats.t) < {3 * HOUR}))::int)
      / nullif(count(*) // 2, 0)::double, 0), 6) as weak_ratio from beats group by user_id""")
def jon11(spark, sf):
    near = iv.nearest(beats(spark, sf), onsets(spark, sf).select("user_id", "t"), ["user_id"], "t", b.day_of, [])
    weak = (F.col("i") % 4).isin(1, 3) & F.coalesce(F.col("gap") < 3 * HOUR, F.lit(False))
    half = F.floor(F.count(F.lit(1)) / 2)
    return rounded(near.groupBy("user_id").agg(s.safe(F.try_divide(F.count_if(weak), F.nullif(half, F.lit(0)))).alias("weak_ratio")))


@query("jon13_beat_window_energy", b.with_("ev", **BEAT) + f"""
    select p.event_id, round(sqrt(avg(o.value * o.value)), 5) as rms, count(*) as n from beats p join ev o on o.user_id = p.user_id and abs(o.t - p.t) <= {4 * HOUR} group by 1""")
def jon13(spark, sf):
    samples = b.events(spark, sf).select("user_id", "t", "value")
    v = F.col("value")
    w = iv.window_totals(beats(spark, sf).select("user_id", "t", "event_id"), samples, ["user_id"], "t", float(b.DAY), 4 * HOUR,
                         {"squares": v * v, "seen": F.lit(1.0)})
    return w.select("event_id", F.round(F.sqrt(F.col("squares") / F.col("seen")), 5).alias("rms"), F.col("seen").cast("long").alias("n"))


SPANS = dict(**BEAT, ends="select user_id, min(t) as lo, max(t) as hi from ev group by 1",
             spans="select user_id, k, lo + k * (hi - lo) / 4 as s, lo + (k + 1) * (hi - lo) / 4 as e from ends, (select unnest(range(4)) as k)",
             g="select *, lag(t) over (partition by user_id order by t, event_id) as pt from beats")


@query("jon12_section_beats", b.with_("ev", **SPANS) + """
    select user_id, k, count(*) as n_beats, round(case when count(*) > 3 then greatest(0, least(1, 1 - stddev_pop(case when pt >= s then t - pt end) / avg(case when pt >= s then t - pt end))) else 0.5 end, 6)::double as stability
    from g join spans using (user_id) where t between s and e group by 1, 2""")
def jon12(spark, sf):
    """Beats in the four time spans of a song, with the regularity of their gaps."""
    ends = b.events(spark, sf).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cut = lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / 4
    spans = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select("user_id", "k", cut(F.col("k")).alias("s"), cut(F.col("k") + 1).alias("e"))
    g = with_neighbours(b.events(spark, sf).where(F.col("event_type").isin("view", "click")).select("user_id", "t", "event_id"),
                        ["user_id"], ["t", "event_id"], b.day_of(F.col("t")), [])
    j = iv.salted_interval_join(g.select("user_id", "t", "event_id", F.col("prev.t").alias("pt")), spans, ["user_id"], "t", "s", "e", F.col("event_id"))
    gap = F.when(F.col("pt") >= F.col("s"), F.col("t") - F.col("pt"))
    steady = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.try_divide(F.stddev_pop(gap), F.avg(gap))))
    n = F.count(F.lit(1))
    return rounded(j.groupBy("user_id", "k").agg(n.alias("n_beats"), F.when(n > 3, steady).otherwise(0.5).alias("stability")))


# --- sections of a song ----------------------------------------------------------------------

SECTION_SQL = dict(c="select *, count(*) over (partition by user_id) as n from frames",
    p="select *, (f >= n // 4)::int + (f >= n * 2 // 4)::int + (f >= n * 3 // 4)::int as part from c",
    sec="""select user_id, part, any_value(n) as n, count(*) * 1.7 as seconds, (any_value(n) * part // 4) * 1.7 as start, any_value(n) * 1.7 as song_seconds,
      avg(x) * 0.6 as energy, 1 - stddev_pop(x) as stability from p group by 1, 2""",
    kinds="""select *, case when part = 0 then 'intro' when part = 3 then 'outro' when seconds < 15 then 'bridge'
      when energy > 0.25 and start / song_seconds > 0.2 and start / song_seconds < 0.8 then 'chorus' when stability > 0.7 and energy > 0.15 and energy < 0.3 then 'verse'
      when energy < 0.2 and start / song_seconds > 0.3 and start / song_seconds < 0.7 then 'bridge' when energy > 0.25 then 'chorus' else 'verse' end as kind from sec""",
    base="""select *, case kind when 'intro' then ['basic_step', 'side_step'] || case when seconds > 20 then ['forward_backward'] else [] end
      when 'verse' then ['basic_step', 'forward_backward', 'side_step'] || case when energy > 0.2 then ['cross_body_lead', 'hammerlock'] else [] end || case when stability > 0.8 then ['lady_left_turn'] else [] end
      when 'chorus' then ['cross_body_lead', 'lady_left_turn', 'lady_right_turn'] || case when energy > 0.3 then ['copa', 'turns', 'styling'] else [] end || case when energy > 0.4 then ['advanced_turns', 'body_roll'] else [] end
      when 'bridge' then ['basic_step', 'arm_styling'] || case when seconds > 15 then ['body_roll', 'dips'] else [] end || case when energy < 0.15 then ['body_roll'] else [] end
      else ['basic_step', 'dips'] || case when seconds > 10 then ['arm_styling', 'body_roll'] else [] end end as types0 from kinds""",
    typed="""select *, case when energy > 0.35 and not list_contains(types0, 'styling') then types0 || ['styling']
      when energy < 0.15 then [z for z in types0 if z in ('basic_step', 'body_roll', 'arm_styling')] else types0 end as types from base""")


def sections(spark, sf):
    """Four sections per song with energy, stability, times, kind and recommended types."""
    cut = lambda i: F.floor(F.col("n") * i / 4)
    part = F.when(F.col("f") >= cut(3), 3).when(F.col("f") >= cut(2), 2).when(F.col("f") >= cut(1), 1).otherwise(0)
    d = s.with_whole(b.frames(spark, sf), K, n=F.count(F.lit(1))).withColumn("part", part)
    g = d.groupBy(*K, "part").agg(
        F.max("n").alias("n"), (F.count(F.lit(1)) * 1.7).alias("seconds"), (F.avg("x") * 0.6).alias("energy"), (1.0 - F.stddev_pop("x")).alias("stability"))
    g = g.withColumns({"start": F.floor(F.col("n") * F.col("part") / 4) * 1.7, "song_seconds": F.col("n") * 1.7})
    c = F.col
    g = g.withColumn("kind", music.section_type(c("part"), F.lit(4), c("energy"), c("start"), c("seconds"), c("song_seconds"), c("stability")))
    return g.withColumn("types", music.section_types(c("kind"), c("energy"), c("stability"), c("seconds")))


@query("prj30_section_classification", b.with_("frames", **SECTION_SQL) + "select user_id, part, kind, round(energy, 6) as energy, round(stability, 6) as stability from kinds")
def prj30(spark, sf):
    return rounded(sections(spark, sf).select(*K, "part", "kind", "energy", "stability"))


@query("prj31_section_types", b.with_("frames", **SECTION_SQL) + "select user_id, part, kind, array_to_string(types, ',') as types from typed")
def prj31(spark, sf):
    return sections(spark, sf).select(*K, "part", "kind", F.array_join("types", ",").alias("types"))


@query("jon14_section_candidates", b.with_("frames", "items", **SECTION_SQL, k="select label, energy as level, count(*) as n from items group by 1, 2",
      hit="""select t.user_id, t.part, coalesce(sum(k.n) filter (len([z for z in t.types if contains(k.label, z)]) > 0
        or abs(t.energy - case level when 'low' then 0.3 when 'medium' then 0.6 else 0.9 end) < 0.4), 0) as m from typed t, k group by 1, 2""") + """
    select user_id, part, m::bigint as n_matching, case when m = 0 then (select count(*) from items) else m end::bigint as n_candidates from hit""")
def jon14(spark, sf):
    """Candidates per section, from the catalogue's (label, level) counts: at most 36 classes."""
    k = b.items(spark, sf).groupBy("label", "energy").agg(F.count(F.lit(1)).alias("n"))
    table = k.agg(F.collect_list(F.struct("label", "energy", "n"))).scalar()
    total = k.agg(F.sum("n")).scalar()

    def fits(c):
        named = F.exists("types", lambda t: F.contains(c["label"], t))
        level = F.when(c["energy"] == "low", 0.3).when(c["energy"] == "medium", 0.6).otherwise(0.9)
        return named | (F.abs(F.col("energy") - level) < 0.4)

    m = F.aggregate(F.filter("classes", fits), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    out = sections(spark, sf).withColumn("classes", table).withColumn("n_matching", m)
    return out.select(*K, "part", "n_matching", F.when(F.col("n_matching") == 0, total).otherwise(F.col("n_matching")).alias("n_candidates"))


@query("prj19_level_detection", b.with_("frames", m="""select user_id, least(1, avg(x) * 0.5) * 0.3 + least(1, (90 + user_id % 61) / 130.0) * 0.2 + least(1, avg(y) * 3000 / 2000) * 0.2
      + least(1, avg(abs(x - y)) * 2.5) * 0.2 + least(1, var_pop(x) * 10) * 0.1 as s from frames group by user_id""") + """
    select user_id, round(coalesce(s, 0), 6) as score, case when s < 0.35 then 'low' when s < 0.65 then 'medium' else 'high' end as level from m""")
def prj19(spark, sf):
    g = b.frames(spark, sf).groupBy(*K).agg(
        (F.avg("x") * 0.05).alias("rms"), (F.avg("y") * 3000).alias("centroid"), (F.avg(F.abs(F.col("x") - F.col("y"))) * 0.5).alias("percussive"),
        (F.var_pop("x") * 0.1).alias("variance"))
    c = F.col
    score = music.level_score(c("rms"), (90 + c("user_id") % 61).cast("double"), c("centroid"), c("percussive"), c("variance"))
    return rounded(g.select(*K, score.alias("score")).withColumn("level", music.level_of(c("score"))))


@query("agg10_detection_quality", b.with_("frames", q="""select user_id, avg((y > 0.1)::int) as rate, avg(x) as conf, stddev_pop(x) as sd, count(*) filter (x < 0.5) as low, count(*) as n from frames group by 1""") + """
    select user_id, round(rate, 6) as rate, round(conf, 6) as confidence, round(sd, 6) as std, low as n_low,
      round(0.4 * least(1, rate / 0.8) + 0.4 * least(1, conf / 0.6) + 0.2 * greatest(0, 1 - low / n::double / 0.2), 6) as score,
      array_to_string([z for z in [case when rate < 0.8 then 'low_detection' end, case when conf < 0.6 then 'low_confidence' end, case when low / n::double > 0.2 then 'many_low_frames' end] if z is not null], ',') as issues from q""")
def agg10(spark, sf):
    return rounded(detection_quality(b.frames(spark, sf)))


def detection_quality(frames):
    n = F.count(F.lit(1))
    g = frames.groupBy(*K).agg(
        F.avg((F.col("y") > 0.1).cast("int")).alias("rate"), F.avg("x").alias("confidence"), F.stddev_pop("x").alias("std"), F.count_if(F.col("x") < 0.5).alias("n_low"), n.alias("n"))
    share = F.col("n_low") / F.col("n")
    score = F.least(F.lit(1.0), F.col("rate") / 0.8) * 0.4 + F.least(F.lit(1.0), F.col("confidence") / 0.6) * 0.4 + F.greatest(F.lit(0.0), 1.0 - share / 0.2) * 0.2
    issues = F.array_compact(F.array(
        F.when(F.col("rate") < 0.8, F.lit("low_detection")), F.when(F.col("confidence") < 0.6, F.lit("low_confidence")), F.when(share > 0.2, F.lit("many_low_frames"))))
    return g.select(*K, "rate", "confidence", "std", "n_low", score.alias("score"), F.array_join(issues, ",").alias("issues"))


# --- clip features -----------------------------------------------------------------------------

def clip_dynamics(spark, sf, parts=cf.PARTS):
    poses = b.poses_of_vectors(spark, sf)
    return cf.dynamics(cf.clip_frames(b.pose_keys(spark, sf), poses, K), poses, K, parts)


@query("win17_feature_blocks")
def win17(spark, sf):
    """Region (32), stability (16), geometry (24) and temporal (20) blocks: size and sum of each."""
    blocks = {"region": cf.region_block(), "stability": cf.stability_block(), "geometric": cf.geometric_block(), "temporal": cf.temporal_block()}
    d = clip_dynamics(spark, sf).select(*K, *[F.array(*[s.safe(x) for x in v]).alias(k) for k, v in blocks.items()])
    return rounded(d.select(*K, *[F.size(k).alias(f"{k}_size") for k in blocks], *[vectors.vec_sum(F.col(k)).alias(f"{k}_sum") for k in blocks]))


from .series import COORD, POSED  # noqa: E402

DYN = dict(**COORD,
    w1="select *, cx - lag(cx) over w as vx, cy - lag(cy) over w as vy from posed window w as (partition by user_id order by f)",
    w2="select *, sqrt(vx * vx + vy * vy) as speed from w1",
    w3="select *, vx - lag(vx) over w as ax, vy - lag(vy) over w as ay, speed - lag(speed) over w as dspeed from w2 window w as (partition by user_id order by f)",
    w4="select *, sqrt(ax * ax + ay * ay) as accel from w3",
    w5="select *, abs(accel - lag(accel) over w) as daccel, sign(dspeed) - sign(lag(dspeed) over w) as turn from w4 window w as (partition by user_id order by f)",
    w6="""select *, coalesce(daccel > avg(daccel) over g + stddev_pop(daccel) over g and daccel > lag(daccel) over w and daccel > lead(daccel) over w, false) or coalesce(abs(turn) > 1, false) as tr,
      sqrt(power(lm[28].x - lm[29].x, 2) + power(lm[28].y - lm[29].y, 2)) as foot_gap,
      (part_left_arm > 0.01)::int + (part_right_arm > 0.01)::int + (part_left_leg > 0.01)::int + (part_right_leg > 0.01)::int + (part_head > 0.01)::int as moving
      from w5 window w as (partition by user_id order by f), g as (partition by user_id)""",
    dyn="""select user_id, count(*) as n, (max(cx) - min(cx)) * (max(cy) - min(cy)) as coverage, coalesce(1 / (1 + stddev_pop(speed) / (avg(speed) + 1e-6)), 0) as rhythm,
      coalesce(avg(speed), 0) as ms, coalesce(stddev_pop(speed), 0) as ss, coalesce(stddev_pop(accel), 0) as sa, count(*) filter (tr) as ntr, count(*) filter (turn <> 0) as nturn, count(speed) as m,
      """ + " + ".join(f"case when avg({j}) > 0 then least(1, stddev_pop({j}) / avg({j})) else stddev_pop({j}) / 180 end" for j in s.JOINT_NAMES) + """ as jsum,
      (""" + " + ".join(f"stddev_pop({j})" for j in vocab.JOINTS) + """) / 4 / 180 as complexity, sqrt(var_pop(cx) + var_pop(cy)) as sway, stddev_pop(foot_gap) as fg, stddev_pop(confidence) as cs,
      coalesce(avg(moving), 0) as mm, coalesce(max(moving), 0) as mx from w6 group by 1""",
    scored="""select *, greatest(0, least(1, 0.25 * case when n < 2 then 0 else jsum / 5 end + 0.2 * least(1, coverage * 10)
        + 0.15 * case when m < 2 then 0 else 0.7 * least(1, case when ms > 1e-6 then ss / ms else ss * 100 end) + 0.3 * least(1, nturn / m::double * 2) end
        + 0.15 * greatest(0, coalesce(cc, 0)) + 0.15 * least(1, ntr / dyn.n::double * 2) + 0.1 * (1 - rhythm))) as cplx from dyn join coord using (user_id, n)""")


@query("win18_complexity_score", b.with_("pose_frames", **DYN) + "select user_id, n, round(cplx, 5)::double as complexity from scored")
def win18(spark, sf):
    return rounded(clip_dynamics(spark, sf, ()).select(*K, "n", cf.complexity_score().alias("complexity")), 5)


@query("win19_tempo_range", b.with_("pose_frames", **DYN, sp="select user_id, f - 1 as i, speed, avg(speed) over g as mu, stddev_pop(speed) over g as sd, count(*) over g as m from w2 where speed is not null window g as (partition by user_id)",
      ac="select a.user_id, c.i - a.i as lag, any_value(a.m) as m, sum((a.speed - a.mu) / (a.sd + 1e-6) * (c.speed - c.mu) / (c.sd + 1e-6)) as z from sp a join sp c on a.user_id = c.user_id and c.i >= a.i group by 1, 2",
      rc="select user_id, coalesce(case when any_value(m) >= 4 then greatest(0, max(z) filter (lag >= 2 and lag < m // 2) / max(z) filter (lag = 0)) end, 0) as rc from ac group by 1",
      r="""select user_id, n, case when ms < 0.01 then -20 when ms > 0.05 then 10 else 0 end + case when ms < 0.01 then -15 when ms < 0.03 then 0 else 5 end
        + case when complexity < 0.3 then -10 when complexity > 0.7 then -5 else 0 end + case when rc > 0.7 then -5 when rc < 0.3 then -15 else 0 end as a,
        case when ms < 0.01 then -10 when ms > 0.05 then 20 else 0 end + case when ms < 0.01 then -5 when ms < 0.03 then 0 else 15 end
        + case when complexity < 0.3 then 10 when complexity > 0.7 then 5 else 0 end + case when rc > 0.7 then 5 when rc < 0.3 then 15 else 0 end as h from dyn join rc using (user_id)""") + """
    select user_id, case when greatest(80, 90 + a) >= least(160, 150 + h) then least(160, 150 + h) - 10 else greatest(80, 90 + a) end::double as low, least(160, 150 + h)::double as high from r where n >= 2""")
def win19(spark, sf):
    low, high = cf.tempo_range()
    return clip_dynamics(spark, sf, ("rhythms",)).where("n >= 2").select(*K, low.alias("low"), high.alias("high"))


@query("win20_difficulty_score", b.with_("pose_frames", **DYN, z="""select *, 0.2 * least(1, ms * 20) + 0.2 * cplx + 0.15 * case when n < 2 then 0 else least(1, (0.6 * mm + 0.4 * mx) / 5) end
      + 0.15 * list_avg([q for q in [case when n > 1 then least(1, sway * 10) end, least(1, fg * 5), case when n > 1 then least(1, sa * 2) end, least(1, cs * 2)] if q is not null])
      + 0.1 * (1 - rhythm) + 0.1 * least(1, coverage * 5) + 0.1 * least(1, ntr / n::double * 3) as d from scored""") + "select user_id, round(greatest(0, least(1, d)), 5)::double as difficulty from z")
def win20(spark, sf):
    return rounded(clip_dynamics(spark, sf, ()).select(*K, cf.difficulty_score().alias("difficulty")), 5)


FOOT = ", ".join(f"lm[{i + 1}]" for i in vocab.FOOT_POINTS)


#: The hull by walking round it: from the lowest point always to the point of the smallest turn, the furthest of equal ones.
HULL_SQL = b.with_("pose_frames", pts=f"select distinct user_id, p.x as x, p.y as y from (select user_id, unnest([{FOOT}]) as p from pose_frames)",
    low="select user_id, arg_min(struct_pack(x := x, y := y), (y, x)) as p from pts group by 1").replace("with ", "with recursive ", 1) + f""",
    walk as (
      select user_id, p.x as x0, p.y as y0, p.x as x, p.y as y, 0.0::double as dir, 0.0::double as area, 0 as k from low
      union all
      select user_id, x0, y0, qx, qy, angle, area + (x - x0) * (qy - y0) - (qx - x0) * (y - y0), k + 1 from (
        select w.*, q.x as qx, q.y as qy, atan2(q.y - w.y, q.x - w.x) as angle, row_number() over (partition by w.user_id order by
          round((atan2(q.y - w.y, q.x - w.x) - w.dir + 4 * pi() + 1e-11) % (2 * pi()), 10), power(q.x - w.x, 2) + power(q.y - w.y, 2) desc) as best
        from walk w join pts q on q.user_id = w.user_id and (q.x <> w.x or q.y <> w.y) where w.k = 0 or w.x <> w.x0 or w.y <> w.y0) where best = 1),
    hull as (select user_id, max_by(area, k) / 2 as area from walk group by 1),
    sums as (select user_id, count(*) as n, ({' + '.join(f'stddev_pop(lm[{i + 1}].{k})' for i in range(11, 17) for k in 'xy')}) / 12 as upper from pose_frames group by 1),
    box as (select user_id, (max(x) - min(x)) * (max(y) - min(y)) as foot_box from pts group by 1)
    select user_id, round(case when n < 2 then 0 else area end, 6)::double as foot_area, round(foot_box, 6) as foot_box, round(case when n < 2 then 0 else upper end, 6)::double as upper_range
    from sums join hull using (user_id) join box using (user_id)"""


@query("win21_area_and_range", HULL_SQL)
def win21(spark, sf):
    """Hull area of the foot points, never above the box area, and the upper-body range."""
    return rounded(clip_dynamics(spark, sf, ("landmarks", "feet")).select(*K, "foot_area", "foot_box", "upper_range"))


@query("win21_box_area", b.with_("pose_frames", pts=f"select user_id, unnest([{FOOT}]) as p from pose_frames") + """
    select user_id, round((max(p.x) - min(p.x)) * (max(p.y) - min(p.y)), 6) as foot_box from pts group by 1""")
def win21_box(spark, sf):
    p = b.pose_frames(spark, sf).select(*K, F.inline(F.array(*[F.get("landmarks", i) for i in vocab.FOOT_POINTS])))
    span = lambda c: F.max(c) - F.min(c)
    return rounded(p.groupBy(*K).agg((span("x") * span("y")).alias("foot_box")))


@query("win22_clip_vectors")
def win22(spark, sf):
    """Pose vector (384), movement vector (26) and analysis quality per clip."""
    d = clip_dynamics(spark, sf).select(*K, cf.pose_vector().alias("pose"), cf.movement_vector().alias("move"), (F.col("confidence_mean") * 0.7).alias("quality"))
    return rounded(d.select(
        *K, F.size("pose").alias("pose_dim"), F.size("move").alias("move_dim"), vectors.norm(F.col("pose")).alias("pose_norm"),
        vectors.vec_sum(F.slice("pose", 283, 102)).alias("pose_tail"), vectors.norm(F.col("move")).alias("move_norm"), "quality"))


@query("prj39_movement_feature_row")
def prj39(spark, sf):
    f = cf.feature_row()
    return rounded(clip_dynamics(spark, sf).select(*K, *[v.alias(k) for k, v in f.items()]))


# --- song vectors --------------------------------------------------------------------------------

def song_frames(spark, sf):
    """Frames with timbre, harmony and energy columns read off the vector of the event."""
    fr = s.moving_average(b.frames(spark, sf), K, "x").withColumn("vec_id", F.col("event_id") % b.vector_count(spark, sf))
    return fr.join(b.vectors(spark, sf), "vec_id").select(
        *K, "f", "t", "smooth", F.slice("vec", 1, 13).alias("mfcc"), F.transform(F.slice("vec", 14, 12), F.abs).alias("chroma"),
        (1500 + F.get("vec", 25) * 1000).alias("centroid"), F.abs(F.get("vec", 26)).alias("zcr"), F.col("x").alias("rms"), F.get("vec", 27).alias("harmonic"),
        F.get("vec", 28).alias("percussive"))


def song_summary(spark, sf):
    """Frame summary joined with the song's rhythm, tempo and sections."""
    fr = song_frames(spark, sf)
    gap = F.col("t") - F.lag("t").over(s._w(K))
    gaps = s.own(s.haloed(fr.select(*K, "f", "t"), 1, 0).withColumn("g", gap)).groupBy(*K).agg(s.safe(F.avg("g"), 0.5).alias("gap_mean"), s.safe(F.stddev_pop("g"), 0.1).alias("gap_std"), s.safe(F.sum("g")).alias("seconds"))
    rhythm = s.regularity(song_beats(spark, sf), K, "t", 8).select(*K, F.col("regularity").alias("_r"))
    sec = sections(spark, sf)
    per = sec.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_sections"),
        *[fn("seconds").alias(f"section_seconds_{k}") for k, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        F.avg("energy").alias("section_energy_mean"), F.stddev_pop("energy").alias("section_energy_std"), (F.max("energy") - F.min("energy")).alias("section_energy_range"),
        *[F.count_if(F.col("kind") == t).alias(f"section_{t}") for t in ("intro", "verse", "chorus", "bridge", "outro")],
        F.avg("stability").alias("stability_mean"), F.stddev_pop("stability").alias("stability_std"))
    return (
        sf_.frame_summary(fr, K).join(gaps, K).join(per, K).join(rhythm, K, "left")
        .withColumns({"rhythm": s.safe(F.col("_r"), 0.5), "sync": F.lit(0.4), "tempo": (90 + F.col("user_id") % 61).cast("double")}))


def _song_query(name, vector):
    @query(name)
    def run(spark, sf):
        v = song_summary(spark, sf).select(*K, "n", vector().alias("v"))
        return rounded(v.select(*K, "n", F.size("v").alias("dim"), vectors.norm(F.col("v")).alias("length"), vectors.vec_sum(F.col("v")).alias("total")))


_song_query("win23_song_vector", sf_.song_vector)
_song_query("win24_fusion_song_vector", sf_.fusion_vector)
