"""Time-series features of whole songs, of any length.

A song is cut into units of UNIT rows by the position of its rows. Windows run inside a unit that also holds the few rows
around it that they reach (its halo); what they give is summed over units, partly before the shuffle. Values of the whole
song (means, counts, limits) are aggregates that are joined back. Lag products and Fourier sums are worked out for pairs
of units and added up. So no song is one sorted group or one array, and the unit has no part in a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pose, vectors, vocab
from ..functions.music import flag


#: Rows of a unit.
UNIT = 4096
#: Frequencies that one call works out.
WAVES = 256


def _w(keys: list[str], order: str = "f"):
    """Order inside a unit; see `haloed`."""
    return Window.partitionBy(*keys, "_u").orderBy(order)


def unit_of(order: str = "f") -> Column:
    return F.floor(F.col(order) / UNIT)


def haloed(df: DataFrame, before: int, after: int, order: str = "f") -> DataFrame:
    """Rows with their unit `_u`; rows near an end are also in the next unit, which reaches `before` rows back and `after` ahead.

    `order` counts the rows of a song from 0.
    """
    u, at = unit_of(order), F.col(order) % UNIT
    seats = F.array_compact(F.array(u, F.when((at < after) & (u > 0), u - 1), F.when(at >= UNIT - before, u + 1)))
    return df.withColumn("_u", F.explode(seats))


def own(df: DataFrame, order: str = "f") -> DataFrame:
    """Every row once, in its own unit."""
    return df.where(unit_of(order) == F.col("_u")).drop("_u")


def with_whole(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates of the whole song on each of its rows."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()]), keys, "left")


def safe(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(default))


def _moves(units: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Velocity, speed, acceleration and their changes, in units that reach four rows back and one ahead; every row once."""
    w = _w(keys)
    v = units.withColumns({"vx": F.col(x) - F.lag(x).over(w), "vy": F.col(y) - F.lag(y).over(w)})
    v = v.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    a = v.withColumns({
        "ax": F.col("vx") - F.lag("vx").over(w), "ay": F.col("vy") - F.lag("vy").over(w),
        "dspeed": F.col("speed") - F.lag("speed").over(w),
        "prev_vx": F.lag("vx").over(w), "prev_vy": F.lag("vy").over(w), "prev_speed": F.lag("speed").over(w),
    })
    a = a.withColumn("accel", F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")))
    a = a.withColumns({
        "daccel": F.abs(F.col("accel") - F.lag("accel").over(w)),
        "turn": F.signum("dspeed") - F.signum(F.lag("dspeed").over(w)),
    })
    return own(a.withColumns({"_daccel_before": F.lag("daccel").over(w), "_daccel_after": F.lead("daccel").over(w)}))


def _transitions(moves: DataFrame) -> DataFrame:
    """Transition marks, by the limit `_limit` of the song."""
    d = F.col("daccel")
    peak = (d > F.col("_limit")) & (d > F.col("_daccel_before")) & (d > F.col("_daccel_after"))
    return moves.withColumn("is_transition", F.coalesce(peak, F.lit(False)) | F.coalesce(F.abs("turn") > 1, F.lit(False))).drop(
        "_limit", "_daccel_before", "_daccel_after")


def _limit() -> Column:
    return F.avg("daccel") + F.stddev_pop("daccel")


def kinematics(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per frame: velocity, speed, acceleration, their changes, and transition marks."""
    return _transitions(with_whole(_moves(haloed(df, 4, 1), keys, x, y), keys, _limit=_limit()))


def kinematics_in_units(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """As `kinematics` and `with_path_columns`, with the number `_n` of rows of the song, for a written table of many columns.

    Values of the whole song come from the few columns they need and are joined to units, so that wide rows are shuffled once
    and those of a unit end in one partition.
    """
    few = df.select(*keys, "f", x, y)
    limits = _moves(haloed(few, 4, 1), keys, x, y).groupBy(*keys).agg(_limit().alias("_limit"))
    whole = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mid")).join(limits, keys)
    units = haloed(few, 4, 1).select(*keys, "_u").distinct().join(whole, keys)
    return _path_columns(_transitions(_moves(haloed(df, 4, 1).join(units, [*keys, "_u"]), keys, x, y)), x)


def movement_aggs(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates of a kinematics table that `finish_movement` needs."""
    span = lambda c: F.max(c) - F.min(c)
    return [
        F.count(F.lit(1)).alias("n"), (span(x) * span(y)).alias("coverage"),
        safe(1.0 / (1.0 + F.stddev_pop("speed") / (F.avg("speed") + 1e-6))).alias("rhythm"),
        (F.max_by(x, "f") - F.min_by(x, "f")).alias("_dx"), (F.max_by(y, "f") - F.min_by(y, "f")).alias("_dy"),
        *[safe(fn(c)).alias(f"{c}_{k}") for c in ("speed", "accel")
          for k, fn in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))],
        F.count_if("is_transition").alias("n_transitions"),
        F.count_if(F.col("turn") != 0).alias("n_turns"),
    ]


def finish_movement(df: DataFrame) -> DataFrame:
    """Direction of the whole displacement and level of the mean speed."""
    direction = (
        F.when(F.col("n") < 2, "static")
        .when(F.abs("_dx") > F.abs("_dy"), F.when(F.col("_dx") > 0, "horizontal").otherwise("horizontal_left"))
        .when(F.col("_dy") < 0, "vertical_up").otherwise("vertical_down")
    )
    level = F.when(F.col("speed_mean") < 0.01, "low").when(F.col("speed_mean") < 0.03, "medium").otherwise("high")
    return df.withColumns({"direction": direction, "level": level})


def movement(kin: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Coverage, rhythm, direction, level and transition count of each clip."""
    return finish_movement(kin.groupBy(*keys).agg(*movement_aggs(x, y))).drop("_dx", "_dy")


def moving_average(df: DataFrame, keys: list[str], value: str, name: str = "smooth") -> DataFrame:
    """Ten wide, zero padded: five rows before to four rows after, over ten."""
    return own(haloed(df, 5, 4).withColumn(name, F.sum(value).over(_w(keys).rowsBetween(-5, 4)) / 10.0))


def regularity(df: DataFrame, keys: list[str], t: str, at_least: int) -> DataFrame:
    """1 - std/mean of the gaps between consecutive rows, in [0, 1]; 0.5 for too few rows. `i` counts the rows."""
    gaps = own(haloed(df, 1, 0, "i").withColumn("_gap", F.col(t) - F.lag(t).over(_w(keys, "i"))), "i")
    ratio = F.try_divide(F.stddev_pop("_gap"), F.avg("_gap"))
    ok = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - ratio))
    n = F.count(F.lit(1))
    return gaps.groupBy(*keys).agg(n.alias("n"), F.when(n < at_least, 0.5).otherwise(safe(ok, 0.5)).alias("regularity"))


def measures(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strong (1st, 3rd) over weak (2nd, 4th) beats of each complete group of four; `i` counts the beats."""
    beats = df.withColumn("_i", F.col("i")).withColumn("_m", F.floor(F.col("_i") / 4))
    strong = F.sum(F.when(F.col("_i") % 2 == 0, F.col(value))) / 2.0
    weak = F.sum(F.when(F.col("_i") % 2 == 1, F.col(value))) / 2.0
    m = beats.groupBy(*keys, "_m").agg(F.count(F.lit(1)).alias("_c"), strong.alias("_s"), weak.alias("_w"))
    full = F.col("_c") == 4
    score = F.avg(F.when(full & (F.col("_s") > 0), F.least(F.lit(1.0), F.col("_s") / (F.col("_w") + 1e-6))))
    few = (F.sum("_c") < 8) | (F.count_if(full) < 2)
    return m.groupBy(*keys).agg(F.sum("_c").alias("n"), F.when(few, 0.5).otherwise(safe(score, 0.5)).alias("pattern"))


def alternation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute difference of non-overlapping neighbours, doubled, at most 1; `i` counts the beats."""
    pairs = df.withColumn("_p", F.floor(F.col("i") / 2)).groupBy(*keys, "_p").agg(
        F.count(F.lit(1)).alias("_c"), (F.max(value) - F.min(value)).alias("_d"))
    n = F.sum("_c")
    total = safe(F.sum(F.when(F.col("_c") == 2, F.col("_d"))))
    return pairs.groupBy(*keys).agg(
        n.alias("n"), F.when(n < 4, 0.5).otherwise(F.least(F.lit(1.0), total / F.floor(n / 2) * 2)).alias("alternation"))


def with_peaks(df: DataFrame, keys: list[str], value: str, name: str = "_pk") -> DataFrame:
    w = _w(keys)
    return own(haloed(df, 1, 1).withColumn(name, (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w))))


def peak_density(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strict local maxima over the number of rows."""
    m = with_peaks(df, keys, value)
    n = F.count(F.lit(1))
    return m.groupBy(*keys).agg(n.alias("n"), (F.count_if("_pk") / n).alias("peak_density"))


def trend_and_shape(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Slope per row, slope times n in [-1, 1], and population skewness."""
    n = F.count(F.lit(1))
    slope = safe(F.regr_slope(value, "f"))
    return df.groupBy(*keys).agg(
        n.alias("n"), F.when(n < 2, 0.0).otherwise(slope).alias("slope"),
        F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope * n))).alias("trend"),
        F.when((n < 3) | (F.stddev_pop(value) == 0), 0.0).otherwise(safe(F.skewness(value))).alias("skewness"))


def column_of(rows, field: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda r: r[field])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _products(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sums of products of two pieces by the distance of their places, from -(len(a) - 1) on."""
    return pd.Series([np.correlate(np.asarray(y), np.asarray(x), "full") for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])))
def _waves(v: pd.Series, at: pd.Series, n: pd.Series, first: pd.Series) -> pd.Series:
    """What a piece that begins at row `at` of n adds to the Fourier sums of WAVES frequencies from `first` on."""
    out = []
    for x, a, m, k0 in zip(v, at, n, first):
        k = np.arange(k0, min(k0 + WAVES, m // 2))
        angle = (np.outer(k, np.arange(a, a + len(x))) % m) * (2 * np.pi / m)
        re, im = np.cos(angle) @ x, np.sin(angle) @ x
        out.append([{"re": r, "im": i} for r, i in zip(re, im)])
    return pd.Series(out)


def _pieces(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Units of the series less its mean, as arrays of at most UNIT values, with rows `_m` and rows before the first value."""
    known = df.where(F.col(value).isNotNull())
    d = with_whole(known, keys, _mu=F.avg(value), _m=F.count(F.lit(1)), _from=F.min(order))
    d = d.withColumn("_i", F.col(order) - F.col("_from")).withColumn("_piece", F.floor(F.col("_i") / UNIT))
    rows = F.array_sort(F.collect_list(F.struct("_i", (F.col(value) - F.col("_mu")).alias("x"))))
    return d.groupBy(*keys, "_piece").agg(F.first("_m").alias("_m"), rows.alias("_v")).withColumn("_v", column_of("_v", "x"))


def autocorrelation(df: DataFrame, keys: list[str], value: str, order: str = "f") -> DataFrame:
    """Per song `rhythm_compatibility` (largest lag product from lag 2 on over that of lag 0) and `movement_rhythm` (from lag 1).

    Lags go up to n/2 - 1; both are 0 for fewer than four values. The values of a song follow each other without a gap.
    """
    p = _pieces(df, keys, value, order)
    last = F.floor((F.col("_m") - 1) / UNIT)
    reach = F.least(last, F.col("_piece") + F.floor(F.col("_m") / 2 / UNIT) + 1)
    a = p.withColumn("_other", F.explode(F.sequence("_piece", reach)))
    b = p.select(*keys, F.col("_piece").alias("_other"), F.col("_v").alias("_w"))
    sums = a.join(b, [*keys, "_other"]).select(
        *keys, "_m", ((F.col("_other") - F.col("_piece")) * UNIT - F.size("_v") + 1).alias("_low"), F.posexplode(_products("_v", "_w")).alias("_at", "_r"))
    by_lag = sums.withColumn("_lag", F.col("_low") + F.col("_at")).where("_lag >= 0 and (_lag = 0 or _lag < floor(_m / 2))")
    by_lag = by_lag.groupBy(*keys, "_lag").agg(F.first("_m").alias("_m"), F.sum("_r").alias("_r"))
    zero, enough = F.max(F.when(F.col("_lag") == 0, F.col("_r"))), F.max("_m") >= 4
    peak = lambda first: F.when(enough, F.max(F.when(F.col("_lag") >= first, F.col("_r"))))
    return by_lag.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), safe(F.try_divide(peak(2), zero))).alias("rhythm_compatibility"),
        safe(peak(1) / (zero + 1e-6)).alias("movement_rhythm"))


def spectrum(df: DataFrame, keys: list[str], value: str, order: str = "f") -> DataFrame:
    """Per song `periodicity`: the largest amplitude of the discrete Fourier transform over the sum, without the mean."""
    p = _pieces(df, keys, value, order)
    blocks = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_m") / 2) - 1), F.lit(WAVES).cast("long"))
    part = p.withColumn("_first", F.explode(blocks)).select(
        *keys, "_first", F.posexplode_outer(_waves("_v", F.col("_piece") * UNIT, "_m", "_first")).alias("_at", "_z"))
    wave = part.groupBy(*keys, (F.col("_first") + F.col("_at")).alias("_k")).agg(F.sum("_z.re").alias("re"), F.sum("_z.im").alias("im"))
    amplitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return wave.groupBy(*keys).agg(safe(F.max(amplitude) / (F.sum(amplitude) + 1e-6)).alias("periodicity"))


def with_path_columns(kin: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Distance to the mean x of the clip and turning angle of each frame."""
    return _path_columns(with_whole(kin, keys, _mid=F.avg(x)), x)


def _path_columns(kin: DataFrame, x: str) -> DataFrame:
    cos = F.try_divide(
        F.col("vx") * F.col("prev_vx") + F.col("vy") * F.col("prev_vy"), F.col("speed") * F.col("prev_speed"))
    angle = F.when(
        (F.col("speed") > 1e-6) & (F.col("prev_speed") > 1e-6),
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return kin.withColumns({"_side": F.col(x) - F.col("_mid"), "_angle": angle}).drop("_mid")


def path_aggs(x: str = "x", y: str = "y", prefix: str = "") -> list[Column]:
    """Path shape, smoothness, turning consistency, symmetry and evenness of acceleration."""
    n = F.count(F.lit(1))
    path, gone = safe(F.sum("speed")), F.sqrt(
        F.pow(F.max_by(x, "f") - F.min_by(x, "f"), 2.0) + F.pow(F.max_by(y, "f") - F.min_by(y, "f"), 2.0))
    side, away = F.col("_side"), F.abs("_side")
    left, right = F.var_pop(F.when(side < 0, away)), F.var_pop(F.when(side >= 0, away))
    mean_a = F.avg("accel")
    out = {
        "complexity": F.when(gone < 1e-6, F.when(path > 1e-6, 1.0).otherwise(0.0)).otherwise(F.least(path / gone, F.lit(10.0)) / 10.0),
        "smoothness": safe(1.0 / (1.0 + F.stddev_pop("dspeed") * 100), 1.0),
        "consistency": safe(1.0 / (1.0 + F.stddev_pop("_angle")), 1.0),
        "symmetry": F.when(n < 2, 1.0).otherwise(
            safe(F.greatest(F.lit(0.0), 1.0 - F.abs(left - right) / (left + right + 1e-6)), 0.5)),
        "evenness": F.when((F.count("accel") < 2) | (mean_a < 1e-6), 0.0).otherwise(
            safe(1.0 / (1.0 + F.stddev_pop("accel") / mean_a))),
    }
    return [c.alias(prefix + k) for k, c in out.items()]


def path_descriptors(kin: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return with_path_columns(kin, keys, x).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *path_aggs(x, y))


def equal_parts(df: DataFrame, keys: list[str], value: str, parts: int = 4) -> DataFrame:
    """Mean value per part by both cut rules: size n // parts, and bounds int(i * n / parts)."""
    size = F.floor(F.col("_n") / parts)
    by_size = F.least(F.when(size > 0, F.floor(F.col("f") / size)).otherwise(parts - 1), F.lit(parts - 1))
    cut = lambda i: F.floor(F.col("_n") * i / parts)
    by_bound = sum((F.when(F.col("f") >= cut(i), 1).otherwise(0) for i in range(2, parts)), F.when(F.col("f") >= cut(1), 1).otherwise(0))
    d = with_whole(df, keys, _n=F.count(F.lit(1))).withColumns({"_a": by_size, "_b": by_bound})
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[safe(F.avg(F.when(F.col("_a") == i, F.col(value)))).alias(f"size_{i}") for i in range(parts)],
        *[safe(F.avg(F.when(F.col("_b") == i, F.col(value)))).alias(f"bound_{i}") for i in range(parts)])


def structure_features(parts: list[Column]) -> dict[str, Column]:
    """Ratios and flags of the four part means."""
    first, last = parts[0], parts[-1]
    middle, edge = (parts[1] + parts[2]) / 2.0, (first + last) / 2.0
    steps = list(zip(parts, parts[1:]))
    top, low = F.greatest(*parts), F.least(*parts)
    arr = F.array(*parts)
    return {
        "intro_outro": first / (last + 1e-6), "middle_edge": middle / (edge + 1e-6), "dynamic": top / (low + 1e-6),
        "variability": F.sqrt(vectors.vec_var(arr)), "builds": flag(parts[1] > first), "fades": flag(last < parts[2]),
        "buildup": flag(_any(b > a * 1.2 for a, b in steps)), "breakdown": flag(_any(b < a * 0.8 for a, b in steps)),
        "has_high": flag(top > 0.4), "has_low": flag(low < 0.1),
    }


def _any(conds) -> Column:
    out = None
    for c in conds:
        out = c if out is None else out | c
    return out


def correlation(a, b) -> Column:
    """Pearson correlation as an aggregate; 0 for a constant series."""
    return safe(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def posed(frames: DataFrame, poses: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Frames with angles, centre, box and the displacement of every body group.

    `frames` name their pose by `pose_id`, and `poses` holds the landmarks of each. What hangs on one pose is worked out once for it
    (`more` adds columns of that kind). Only ids go through the window; the points of two poses meet in the joins.
    """
    lm = F.col("landmarks")
    x0, width = pose.extent(lm, "x")
    y0, height = pose.extent(lm, "y")
    groups = {
        **{f"region_{k}": v for k, v in vocab.REGIONS.items()}, **{f"part_{k}": v for k, v in vocab.BODY_PARTS.items()},
        "part_head": [0, 11, 12], "upper": [11, 12, 13, 14, 15, 16], "lower": [23, 24, 25, 26, 27, 28],
    }
    shape = {
        **{j: pose.joint_angle(lm, j) for j in vocab.JOINTS}, "torso_lean": pose.torso_lean(lm),
        "cx": pose.centre(lm, "x"), "cy": pose.centre(lm, "y"), "box_x": x0, "box_y": y0, "box_w": width, "box_h": height, **(more or {}),
    }
    used = sorted({i for points in groups.values() for i in points})
    at = {k: F.array(*[F.get(lm, i)[k] for i in used]) for k in "xy"}
    place = {k: [used.index(i) for i in points] for k, points in groups.items()}
    now = poses.select("pose_id", *[v.alias(k) for k, v in shape.items()], *[v.alias(f"_{k}") for k, v in at.items()])
    was = poses.select(F.col("pose_id").alias("_before"), pose.centre(lm, "x").alias("_was_cx"), pose.centre(lm, "y").alias("_was_cy"),
                       *[v.alias(f"_was_{k}") for k, v in at.items()])
    known = frames.join(poses.select("pose_id"), "pose_id", "left_semi")
    base = own(haloed(known, 1, 0).withColumn("_before", F.lag("pose_id").over(_w(keys))))
    return base.join(was, "_before", "left").join(now, "pose_id").select(
        *keys, "f", "confidence", "pose_id", *shape,
        F.sqrt(sum((F.pow(F.col(f"c{k}") - F.col(f"_was_c{k}"), 2.0) for k in "xy"), F.lit(0.0))).alias("centre_step"),
        *[pose.mean_step(("_x", "_y"), ("_was_x", "_was_y"), points).alias(name) for name, points in place.items()],
    )


JOINT_NAMES = [*vocab.JOINTS, "torso_lean"]


def intensity(posed_df: DataFrame, keys: list[str]) -> DataFrame:
    """0.7 * mean normalised joint offset + 0.3 * centre step, per frame."""
    offsets = [F.abs(F.col(j) - (0.0 if j == "torso_lean" else 180.0)) / 180.0 for j in JOINT_NAMES]
    mean = sum(offsets[1:], offsets[0]) / float(len(offsets))
    return posed_df.withColumn("intensity", mean * 0.7 + safe(F.col("centre_step")) * 0.3)


def coordination_aggs() -> list[Column]:
    """Left-right, upper-lower and x-y correlations, and those of all body part pairs."""
    names = [f"part_{p}" for p in vocab.BODY_PARTS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    raw = [F.abs(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))) for a, b in pairs]
    n = F.count(F.lit(1))
    return [
        F.abs(correlation("left_elbow", "right_elbow")).alias("elbows"), F.abs(correlation("left_knee", "right_knee")).alias("knees"),
        F.when(n > 2, correlation("upper", "lower")).otherwise(0.0).alias("upper_lower"),
        F.when(n > 2, correlation("cx", "cy")).otherwise(0.0).alias("x_y"),
        safe(F.avg("upper")).alias("upper_mean"), safe(F.stddev_pop("upper")).alias("upper_std"),
        safe(F.avg("lower")).alias("lower_mean"), safe(F.stddev_pop("lower")).alias("lower_std"),
        F.array_compact(F.array(*raw)).alias("_corr"),
    ]


def finish_coordination(df: DataFrame) -> DataFrame:
    """1 - mean |correlation| over the body part pairs."""
    known = (F.col("n") > 2) & (F.size("_corr") > 0)
    mean = vectors.vec_mean(F.col("_corr"))
    return df.withColumn(
        "coordination_complexity", F.when(known, F.greatest(F.lit(0.0), 1.0 - mean)).otherwise(0.0)
    ).drop("_corr")


def coordination(posed_df: DataFrame, keys: list[str]) -> DataFrame:
    return finish_coordination(posed_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *coordination_aggs()))
