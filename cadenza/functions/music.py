"""Tempo, level and section rules of a song."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def tempo_fit(tempo: Column) -> Column:
    """Best of three sweet spots, 25 BPM wide on each side."""
    return F.greatest(
        *[F.greatest(F.lit(0.0), 1.0 - F.abs(tempo - s) / 25.0) for s in (100, 120, 140)]
    )


def tempo_features(tempo: Column, rhythm: Column, syncopation: Column) -> Column:
    """Fifteen tempo features."""
    return F.array(
        flag(tempo < 100),
        flag((tempo >= 100) & (tempo < 120)),
        flag((tempo >= 120) & (tempo < 140)),
        flag(tempo >= 140),
        (tempo - 60) / 120.0,
        F.log(tempo / 60.0),
        tempo / 60.0,
        60.0 / tempo,
        tempo * rhythm,
        tempo * (1.0 - syncopation),
        F.abs(tempo - 120),
        (tempo - 90) / 60.0,
        F.when(tempo < 90, F.least(F.lit(1.0), tempo / 90.0)).otherwise(F.least(F.lit(1.0), 180.0 / tempo)),
        flag(tempo.between(110, 130)),
        tempo_fit(tempo),
    )


def rhythm_features(tempo: Column, rhythm: Column, sync: Column) -> Column:
    """Twenty rhythm features of the song vector."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tempo - 60) / 120.0))
    fit = tempo_fit(tempo)

    def hill(centre: float, width: float) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.abs(tempo - centre) / width)

    return F.array(
        scaled, rhythm, sync, rhythm * sync, rhythm * (1.0 - sync), fit,
        hill(100, 20), hill(120, 15), hill(140, 20),
        flag(tempo.between(90, 150)),
        (tempo % 4) / 4.0,
        rhythm * scaled,
        sync * (1.0 - F.abs(tempo - 120) / 60.0),
        flag(rhythm > 0.8), flag(sync > 0.5),
        F.abs(tempo - 120) / 60.0,
        F.when(tempo < 100, F.least(F.lit(1.0), tempo / 100.0)).otherwise(F.least(F.lit(1.0), 200.0 / tempo)),
        rhythm * F.when(tempo.between(110, 130), 1.0).otherwise(0.5),
        sync * fit,
        (rhythm + (1.0 - sync)) / 2.0,
    )


def tempo_is_accurate(detected: Column, expected: Column) -> Column:
    near = F.abs(detected - expected) <= expected * 0.05
    return detected.between(90, 150) & F.coalesce(near | (expected == 0), F.lit(True))


def level_score(rms, tempo, centroid, percussive, variance) -> Column:
    one = F.lit(1.0)
    return (
        F.least(one, rms * 10) * 0.3
        + F.least(one, tempo / 130.0) * 0.2
        + F.least(one, centroid / 2000.0) * 0.2
        + F.least(one, percussive * 5) * 0.2
        + F.least(one, variance * 100) * 0.1
    )


def level_of(score: Column) -> Column:
    return F.when(score < 0.35, "low").when(score < 0.65, "medium").otherwise("high")


def section_type(idx, total, energy, start, duration, song_duration, stability) -> Column:
    where = F.try_divide(start, song_duration)
    return (
        F.when(idx == 0, "intro")
        .when(idx == total - 1, "outro")
        .when(duration < 15, "bridge")
        .when((energy > 0.25) & (where > 0.2) & (where < 0.8), "chorus")
        .when((stability > 0.7) & (energy > 0.15) & (energy < 0.3), "verse")
        .when((energy < 0.2) & (where > 0.3) & (where < 0.7), "bridge")
        .when(energy > 0.25, "chorus")
        .otherwise("verse")
    )


def section_types(kind, energy, stability, duration) -> Column:
    """Recommended item types of a section."""

    def arr(*words):
        return F.array(*[F.lit(w) for w in words])

    none = F.array().cast("array<string>")

    def extra(cond, *words):
        return F.when(cond, arr(*words)).otherwise(none)

    base = (
        F.when(kind == "intro", F.concat(arr("basic_step", "side_step"), extra(duration > 20, "forward_backward")))
        .when(
            kind == "verse",
            F.concat(
                arr("basic_step", "forward_backward", "side_step"),
                extra(energy > 0.2, "cross_body_lead", "hammerlock"),
                extra(stability > 0.8, "lady_left_turn"),
            ),
        )
        .when(
            kind == "chorus",
            F.concat(
                arr("cross_body_lead", "lady_left_turn", "lady_right_turn"),
                extra(energy > 0.3, "copa", "turns", "styling"),
                extra(energy > 0.4, "advanced_turns", "body_roll"),
            ),
        )
        .when(
            kind == "bridge",
            F.concat(
                arr("basic_step", "arm_styling"),
                extra(duration > 15, "body_roll", "dips"),
                extra(energy < 0.15, "body_roll"),
            ),
        )
        .when(
            kind == "outro",
            F.concat(arr("basic_step", "dips"), extra(duration > 10, "arm_styling", "body_roll")),
        )
        .otherwise(arr("basic_step", "side_step", "forward_backward"))
    )
    calm = arr("basic_step", "body_roll", "arm_styling")
    return (
        F.when((energy > 0.35) & ~F.array_contains(base, "styling"), F.concat(base, arr("styling")))
        .when(energy < 0.15, F.filter(base, lambda t: F.array_contains(calm, t)))
        .otherwise(base)
    )
