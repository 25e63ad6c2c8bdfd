"""Time-series features of songs: all observations of a user, in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose, vectors, vocab
from ..operators import series as s
from ..operators.ordering import dense_index
from ..operators.profiles import rounded
from . import binding as b
from .registry import query

K = ["user_id"]
KIN = dict(
    k1="select *, x - lag(x) over w as vx, y - lag(y) over w as vy from frames window w as (partition by user_id order by f)",
    k2="select *, sqrt(vx * vx + vy * vy) as speed from k1",
    k3="""select *, vx - lag(vx) over w as ax, vy - lag(vy) over w as ay, speed - lag(speed) over w as dspeed, lag(vx) over w as pvx, lag(vy) over w as pvy,
      lag(speed) over w as pspeed from k2 window w as (partition by user_id order by f)""",
    k4="select *, sqrt(ax * ax + ay * ay) as accel from k3",
    k5="""select *, abs(accel - lag(accel) over w) as daccel, sign(dspeed) - sign(lag(dspeed) over w) as turn from k4
      window w as (partition by user_id order by f)""",
    kin="""select *, coalesce(daccel > avg(daccel) over g + stddev_pop(daccel) over g and daccel > lag(daccel) over w and daccel > lead(daccel) over w, false)
      or coalesce(abs(turn) > 1, false) as is_transition from k5 window w as (partition by user_id order by f), g as (partition by user_id)""")


def kin(spark, sf):
    return s.kinematics(b.frames(spark, sf), K)


MOVE_SQL = dict(**KIN, mv="""select user_id, count(*) as n, (max(x) - min(x)) * (max(y) - min(y)) as coverage,
      coalesce(1 / (1 + stddev_pop(speed) / (avg(speed) + 1e-6)), 0) as rhythm, arg_max(x, f) - arg_min(x, f) as dx, arg_max(y, f) - arg_min(y, f) as dy,
      coalesce(avg(speed), 0) as mean_speed, coalesce(stddev_pop(accel), 0) as std_accel, count(*) filter (is_transition) as n_transitions from kin group by 1""")


@query("win1_velocity_coverage_direction", b.with_("frames", **MOVE_SQL) + """
    select user_id, n, round(coverage, 6) as coverage, round(rhythm, 6) as rhythm, round(mean_speed, 6) as mean_speed, round(std_accel, 6) as std_accel,
      case when n < 2 then 'static' when abs(dx) > abs(dy) then case when dx > 0 then 'horizontal' else 'horizontal_left' end
        when dy < 0 then 'vertical_up' else 'vertical_down' end as direction,
      case when mean_speed < 0.01 then 'low' when mean_speed < 0.03 then 'medium' else 'high' end as level from mv""")
def win1(spark, sf):
    m = s.movement(kin(spark, sf), K)
    return rounded(m.select(
        *K, "n", "coverage", "rhythm", F.col("speed_mean").alias("mean_speed"), F.col("accel_std").alias("std_accel"), "direction", "level"))


@query("win2_moving_average", b.with_("frames") + """
    select event_id, round(sum(value) over (partition by user_id order by f rows between 5 preceding and 4 following) / 10, 6) as smooth from frames""")
def win2(spark, sf):
    return rounded(s.moving_average(b.frames(spark, sf), K, "value").select("event_id", "smooth"))


BEATS = dict(beats="select * from frames where event_type in ('view', 'click')")


def beats(spark, sf):
    """The beats of a song, numbered from 0."""
    e = b.frames(spark, sf).where(F.col("event_type").isin("view", "click"))
    return dense_index(e, K, ["f"], s.unit_of(), name="i")


@query("win3_interval_regularity", b.with_("frames", **BEATS, g="select user_id, t - lag(t) over (partition by user_id order by t) as gap from beats") + """
    select user_id, count(*) as n, round(case when count(*) < 8 then 0.5 else greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) end, 6) as regularity
    from g group by 1""")
def win3(spark, sf):
    return rounded(s.regularity(beats(spark, sf), K, "t", 8))


@query("win4_measure_pattern", b.with_("frames", **BEATS, i="select *, row_number() over (partition by user_id order by f) - 1 as i from beats",
      m="select user_id, i // 4 as m, count(*) as c, sum(value) filter (i % 2 = 0) / 2 as st, sum(value) filter (i % 2 = 1) / 2 as wk from i group by 1, 2") + """
    select user_id, sum(c)::bigint as n, round(case when sum(c) < 8 or count(*) filter (c = 4) < 2 then 0.5
      else avg(least(1, st / (wk + 1e-6))) filter (c = 4) end, 6) as pattern from m group by 1""")
def win4(spark, sf):
    return rounded(s.measures(beats(spark, sf), K, "value"))


@query("win5_alternation", b.with_("frames", **BEATS, i="select *, row_number() over (partition by user_id order by f) - 1 as i from beats",
      p="select user_id, i // 2 as p, count(*) as c, max(x) - min(x) as d from i group by 1, 2") + """
    select user_id, sum(c)::bigint as n, round(case when sum(c) < 4 then 0.5 else least(1, sum(d) filter (c = 2) / (sum(c) // 2) * 2) end, 6) as alternation
    from p group by 1""")
def win5(spark, sf):
    return rounded(s.alternation(beats(spark, sf), K, "x"))


@query("win6_transition_points", b.with_("frames", **KIN) + "select user_id, f - 2 as point from kin where is_transition")
def win6(spark, sf):
    return kin(spark, sf).where("is_transition").select(*K, (F.col("f") - 2).alias("point"))


@query("win7_peak_density", b.with_("frames", p="""select user_id, value > lag(value) over w and value > lead(value) over w as pk from frames
      window w as (partition by user_id order by f)""") + """
    select user_id, count(*) as n, round(count(*) filter (pk) / count(*)::double, 6) as peak_density from p group by 1""")
def win7(spark, sf):
    return rounded(s.peak_density(b.frames(spark, sf), K, "value"))


# --- lags and waves ---------------------------------------------------------------------

AUTO = dict(**KIN, sp="select user_id, f - 1 as i, speed, count(*) over g as m, avg(speed) over g as mu, stddev_pop(speed) over g as sd from kin where speed is not null window g as (partition by user_id)",
    ac="""select a.user_id, c.i - a.i as lag, any_value(a.m) as m, sum((a.speed - a.mu) / (a.sd + 1e-6) * (c.speed - c.mu) / (c.sd + 1e-6)) as z,
      sum((a.speed - a.mu) * (c.speed - c.mu)) as r from sp a join sp c on a.user_id = c.user_id and c.i >= a.i group by 1, 2""")


@query("win10_autocorrelation_peak", b.with_("frames", **AUTO) + """
    select user_id, round(coalesce(case when any_value(m) >= 4 then greatest(0, max(z) filter (lag >= 2 and lag < m // 2) / max(z) filter (lag = 0)) end, 0), 6) as rhythm_compatibility,
      round(coalesce(case when any_value(m) >= 4 then max(r) filter (lag >= 1 and lag < m // 2) / (max(r) filter (lag = 0) + 1e-6) end, 0), 6) as movement_rhythm
    from ac group by 1""")
def win10(spark, sf):
    return rounded(s.autocorrelation(kin(spark, sf), K, "speed"))


@query("win11_spectral_concentration", b.with_("frames", **AUTO, amp="""select user_id, k, sqrt(power(sum((speed - mu) * cos(2 * pi() * k * i / m)), 2) + power(sum((speed - mu) * sin(2 * pi() * k * i / m)), 2)) as a
      from sp, (select unnest(range(1, (select max(m) // 2 from sp))) as k) where k < m // 2 and m >= 4 group by 1, 2""",
      conc="select user_id, max(a) / (sum(a) + 1e-6) as p from amp group by 1") + """
    select user_id, round(coalesce(p, 0), 6) as periodicity from (select distinct user_id from sp) left join conc using (user_id)""")
def win11(spark, sf):
    return rounded(s.spectrum(kin(spark, sf), K, "speed"))


@query("win12_path_descriptors", b.with_("frames", **KIN, m="""select *, avg(x) over (partition by user_id) as mid,
      case when speed > 1e-6 and pspeed > 1e-6 then acos(greatest(-1, least(1, (vx * pvx + vy * pvy) / (speed * pspeed)))) end as angle from kin""",
      d="""select user_id, count(*) as n, coalesce(sum(speed), 0) as path, sqrt(power(arg_max(x, f) - arg_min(x, f), 2) + power(arg_max(y, f) - arg_min(y, f), 2)) as gone,
        stddev_pop(dspeed) as jerk, stddev_pop(angle) as ang, var_pop(abs(x - mid)) filter (x < mid) as l, var_pop(abs(x - mid)) filter (x >= mid) as r,
        count(accel) as na, avg(accel) as ma, stddev_pop(accel) as sa from m group by 1""") + """
    select user_id, n, round(case when gone < 1e-6 then case when path > 1e-6 then 1 else 0 end else least(path / gone, 10) / 10 end, 6)::double as complexity,
      round(coalesce(1 / (1 + jerk * 100), 1), 6) as smoothness, round(coalesce(1 / (1 + ang), 1), 6) as consistency,
      round(case when n < 2 then 1 else coalesce(greatest(0, 1 - abs(l - r) / (l + r + 1e-6)), 0.5) end, 6)::double as symmetry,
      round(case when na < 2 or ma < 1e-6 then 0 else coalesce(1 / (1 + sa / ma), 0) end, 6)::double as evenness from d""")
def win12(spark, sf):
    return rounded(s.path_descriptors(kin(spark, sf), K))


@query("win13_linear_trend", b.with_("frames") + """
    select user_id, count(*) as n, round(case when count(*) < 2 then 0 else regr_slope(x, f) end, 6)::double as slope,
      round(case when count(*) < 3 then 0 else greatest(-1, least(1, regr_slope(x, f) * count(*))) end, 6)::double as trend from frames group by 1""")
def win13(spark, sf):
    return rounded(s.trend_and_shape(b.frames(spark, sf), K, "x").select(*K, "n", "slope", "trend"))


@query("win14_population_skewness", b.with_("frames", m="select *, avg(x) over g as mu, stddev_pop(x) over g as sd from frames window g as (partition by user_id)") + """
    select user_id, round(case when count(*) < 3 or any_value(sd) = 0 then 0 else avg(power((x - mu) / sd, 3)) end, 6)::double as skewness from m group by 1""")
def win14(spark, sf):
    return rounded(s.trend_and_shape(b.frames(spark, sf), K, "x").select(*K, "skewness"))


@query("win15_equal_parts", b.with_("frames", c="select *, count(*) over (partition by user_id) as n from frames",
      p="select *, case when n // 4 > 0 then least(3, f // (n // 4)) else 3 end as a, (f >= n // 4)::int + (f >= n * 2 // 4)::int + (f >= n * 3 // 4)::int as c from c",
      q="select user_id, count(*) as n, " + ", ".join(f"coalesce(avg(x) filter (a = {i}), 0) as s{i}, coalesce(avg(x) filter (c = {i}), 0) as b{i}" for i in range(4)) + " from p group by 1") + """
    select user_id, n, round(s0, 6) as size_0, round(s3, 6) as size_3, round(b1, 6) as bound_1, round(b3, 6) as bound_3, round(s0 / (s3 + 1e-6), 4) as intro_outro,
      round((s1 + s2) / 2 / ((s0 + s3) / 2 + 1e-6), 4) as middle_edge, (s1 > s0 * 1.2 or s2 > s1 * 1.2 or s3 > s2 * 1.2)::int::double as buildup,
      (s1 < s0 * 0.8 or s2 < s1 * 0.8 or s3 < s2 * 0.8)::int::double as breakdown,
      round(sqrt((power(s0 - m, 2) + power(s1 - m, 2) + power(s2 - m, 2) + power(s3 - m, 2)) / 4), 6) as variability from (select *, (s0 + s1 + s2 + s3) / 4 as m from q)""")
def win15(spark, sf):
    p = s.equal_parts(b.frames(spark, sf), K, "x")
    f = s.structure_features([F.col(f"size_{i}") for i in range(4)])
    return rounded(p.select(
        *K, "n", "size_0", "size_3", "bound_1", "bound_3", F.round(f["intro_outro"], 4).alias("intro_outro"), F.round(f["middle_edge"], 4).alias("middle_edge"),
        f["buildup"].alias("buildup"), f["breakdown"].alias("breakdown"), f["variability"].alias("variability")))


# --- poses -----------------------------------------------------------------------------------

def _angle_sql(a, m, c):
    u = [f"(lm[{a + 1}].{k} - lm[{m + 1}].{k})" for k in "xyz"]
    v = [f"(lm[{c + 1}].{k} - lm[{m + 1}].{k})" for k in "xyz"]
    dot = " + ".join(f"{p} * {q}" for p, q in zip(u, v))
    nu, nv = (" + ".join(f"{p} * {p}" for p in w) for w in (u, v))
    return f"coalesce(degrees(acos(greatest(-1, least(1, ({dot}) / nullif(sqrt({nu}) * sqrt({nv}), 0))))), 180)"


def _mean_step_sql(points):
    return "(" + " + ".join(f"sqrt(power(lm[{i + 1}].x - prev[{i + 1}].x, 2) + power(lm[{i + 1}].y - prev[{i + 1}].y, 2))" for i in points) + f") / {len(points)}"


def _centre_sql(k):
    return "(" + " + ".join(f"lm[{i + 1}].{k}" for i in vocab.CENTRE_POINTS) + ") / 6"


LEAN = ("coalesce(degrees(acos(greatest(-1, least(1, -((lm[24].y + lm[25].y) / 2 - lm[1].y) / nullif(sqrt("
        + " + ".join(f"power((lm[24].{k} + lm[25].{k}) / 2 - lm[1].{k}, 2)" for k in "xyz") + "), 0))))), 0)")
POSED = dict(pp="select *, lag(lm) over (partition by user_id order by f) as prev from pose_frames",
    posed="select user_id, f, confidence, lm, " + ", ".join(f"{_angle_sql(*p)} as {n}" for n, p in vocab.JOINTS.items()) + f""", {LEAN} as torso_lean,
      {_centre_sql('x')} as cx, {_centre_sql('y')} as cy, list_min([p.x for p in lm]) as box_x, list_max([p.x for p in lm]) - list_min([p.x for p in lm]) as box_w,
      list_min([p.y for p in lm]) as box_y, list_max([p.y for p in lm]) - list_min([p.y for p in lm]) as box_h, """
      + ", ".join(f"{_mean_step_sql(p)} as region_{n}" for n, p in vocab.REGIONS.items()) + ", " + ", ".join(f"{_mean_step_sql(p)} as part_{n}" for n, p in vocab.BODY_PARTS.items())
      + f", {_mean_step_sql([11, 12, 13, 14, 15, 16])} as upper, {_mean_step_sql([23, 24, 25, 26, 27, 28])} as lower, {_mean_step_sql([0, 11, 12])} as part_head from pp")


def posed(spark, sf):
    return s.posed(b.pose_keys(spark, sf), b.poses_of_vectors(spark, sf), K)


@query("prj32_joint_angles", b.with_("pose_frames", **POSED) + "select user_id, f, " + ", ".join(f"round({j}, 4) as {j}" for j in s.JOINT_NAMES) + " from posed")
def prj32(spark, sf):
    lm = F.col("landmarks")
    return b.pose_frames(spark, sf).select(
        *K, "f", *[F.round(pose.joint_angle(lm, j), 4).alias(j) for j in vocab.JOINTS], F.round(pose.torso_lean(lm), 4).alias("torso_lean"))


@query("prj33_centroid_and_box", b.with_("pose_frames", **POSED) + "select user_id, f, round(cx, 6) as cx, round(cy, 6) as cy, round(box_x, 6) as box_x, round(box_y, 6) as box_y, round(box_w, 6) as box_w, round(box_h, 6) as box_h from posed")
def prj33(spark, sf):
    lm = F.col("landmarks")
    (x, w), (y, h) = pose.extent(lm, "x"), pose.extent(lm, "y")
    return rounded(b.pose_frames(spark, sf).select(
        *K, "f", pose.centre(lm, "x").alias("cx"), pose.centre(lm, "y").alias("cy"), x.alias("box_x"), y.alias("box_y"), w.alias("box_w"), h.alias("box_h")))


INTENSE = dict(**POSED, intense="""select *, 0.7 * ((180 - left_elbow) / 180 + (180 - right_elbow) / 180 + (180 - left_knee) / 180 + (180 - right_knee) / 180 + torso_lean / 180) / 5
    + 0.3 * coalesce(sqrt(power(cx - lag(cx) over w, 2) + power(cy - lag(cy) over w, 2)), 0) as intensity from posed window w as (partition by user_id order by f)""")


@query("win8_intensity_profile", b.with_("pose_frames", **INTENSE) + "select user_id, f, round(intensity, 6) as intensity from intense")
def win8(spark, sf):
    return rounded(s.intensity(posed(spark, sf), K).select(*K, "f", "intensity"))


@query("win9_regional_displacement", b.with_("pose_frames", **POSED) + "select user_id, " + ", ".join(f"round(coalesce(avg(region_{r}), 0), 6) as {r}" for r in vocab.REGIONS) + " from posed group by 1")
def win9(spark, sf):
    return rounded(posed(spark, sf).groupBy(*K).agg(*[s.safe(F.avg(f"region_{r}")).alias(r) for r in vocab.REGIONS]))


def _corr_sql(a, c):
    return f"covar_pop({a}, {c}) / nullif(stddev_pop({a}) * stddev_pop({c}), 0)"


_P = [f"part_{p}" for p in vocab.BODY_PARTS]
COORD = dict(**POSED, coord=f"""select user_id, count(*) as n, abs(coalesce({_corr_sql('left_elbow', 'right_elbow')}, 0)) as elbows, abs(coalesce({_corr_sql('left_knee', 'right_knee')}, 0)) as knees,
    case when count(*) > 2 then coalesce({_corr_sql('upper', 'lower')}, 0) else 0 end as upper_lower, coalesce(avg(upper), 0) as upper_mean,
    case when count(*) > 2 then 1 - list_avg([z for z in [{', '.join(f'abs({_corr_sql(a, c)})' for i, a in enumerate(_P) for c in _P[i + 1:])}] if z is not null]) end as cc from posed group by 1""")


@query("win16_limb_coordination", b.with_("pose_frames", **COORD) + """
    select user_id, round(elbows, 5) as elbows, round(knees, 5) as knees, round(upper_lower, 5)::double as upper_lower, round(upper_mean, 5) as upper_mean,
      round(greatest(0, coalesce(cc, 0)), 5)::double as coordination_complexity from coord where n > 2""")
def win16(spark, sf):
    c = s.coordination(posed(spark, sf), K).where("n > 2")
    return rounded(c.select(*K, "elbows", "knees", "upper_lower", "upper_mean", "coordination_complexity"), 5)
