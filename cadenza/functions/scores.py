"""Pair and request scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def level_rank(level: Column) -> Column:
    """low/beginner 1, high/advanced 3, everything else 2."""
    low = F.lower(level)
    return (
        F.when(low.isin("low", "beginner"), 1.0)
        .when(low.isin("high", "advanced"), 3.0)
        .otherwise(2.0)
    )


def level_gap(a: Column, b: Column) -> Column:
    return F.abs(level_rank(a) - level_rank(b))


def ladder(a: Column, b: Column, near: float = 0.7, far: float = 0.3) -> Column:
    """1 for equal levels, `near` one step apart, `far` two steps apart."""
    gap = level_gap(a, b)
    return F.when(gap == 0, 1.0).when(gap == 1, near).otherwise(far)


def interval_gap(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - value, value - high, F.lit(0.0))


def interval_compat(value: Column, low: Column, high: Column, tolerance) -> Column:
    """1 inside; falls to 0 at the tolerance; beyond it exp decay from 1."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    gap = interval_gap(value, low, high)
    return (
        F.when(gap == 0, 1.0)
        .when(gap <= tol, 1.0 - gap / tol)
        .otherwise(F.exp(-(gap - tol) / 20.0))
    )


def weighted(parts: dict[str, Column], weights: dict) -> Column:
    """Sum of part times weight; weights are numbers or columns."""
    total = None
    for name, part in parts.items():
        term = part * weights[name]
        total = term if total is None else total + term
    return total


def level_compat(target: Column, own: Column) -> Column:
    """The 1 / 0.7 / 0.3 ladder with 0.5 when either level is unknown."""
    known = target.isin(vocab.ENERGIES) & own.isin(vocab.ENERGIES)
    return F.when(known, ladder(target, own)).otherwise(0.5)


def role_compat(a: Column, b: Column) -> Column:
    return F.when((a == "both") | (b == "both") | (a == b), 1.0).otherwise(0.6)


def difficulty_compat(target: Column, score: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(level_rank(target) - score) / 2.0)


def label_similarity(a: Column, b: Column) -> Column:
    """Symmetric fixed table; 1 for equal labels, else 0.1."""
    out = F.when(a == b, 1.0)
    for x, y, s in vocab.LABEL_SIMILARITY:
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), s)
    return out.otherwise(0.1)


def ordinal_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - level_gap(a, b) * 0.5))


def gaussian_similarity(a: Column, b: Column, width: float = 15.0) -> Column:
    return F.exp(-F.pow(a - b, 2.0) / (2 * width * width))


def step_score(a: Column, b: Column, down: float = 0.7, jump: float = 0.5, worst: float = 0.3) -> Column:
    """Difficulty step from a to b: same 1, one up 0.9, one down / two up / rest as given."""
    step = level_rank(b) - level_rank(a)
    return (
        F.when(step == 0, 1.0).when(step == 1, 0.9).when(step == -1, down)
        .when(step == 2, jump).otherwise(worst)
    )


def pose_transition(end_angles: list[Column], start_angles: list[Column]) -> Column:
    parts = [
        F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / 180.0)
        for a, b in zip(end_angles, start_angles)
    ]
    return sum(parts[1:], parts[0]) / float(len(parts))


def movement_flow(end_speed, start_speed, dir_a, dir_b, cover_a, cover_b) -> Column:
    speed = F.greatest(F.lit(0.0), 1.0 - F.abs(end_speed - start_speed) * 10)
    heading = F.when(dir_a == dir_b, 1.0).otherwise(0.7)
    cover = F.greatest(F.lit(0.0), 1.0 - F.abs(cover_a - cover_b) * 5)
    return speed * 0.4 + heading * 0.3 + cover * 0.3


def transition_flags(score: Column) -> Column:
    smooth, pause = score > 0.7, score < 0.4
    return F.struct(
        smooth.alias("is_smooth"),
        pause.alias("requires_pause"),
        F.when(smooth, 0.5).when(pause, 2.0).otherwise(1.0).alias("seconds"),
    )


def direction_compat(a: Column, b: Column) -> Column:
    sides = ["horizontal", "horizontal_left"]
    heights = ["vertical_up", "vertical_down"]
    known = sides + heights
    return (
        F.when(a == b, 1.0)
        .when(a.isin(sides) & b.isin(sides), 0.8)
        .when(a.isin(heights) & b.isin(heights), 0.6)
        .when((a == "static") & b.isin(known) | (b == "static") & a.isin(known), 0.9)
        .otherwise(0.5)
    )


def rule_truth(label_a, label_b, diff_a, diff_b, energy_a, energy_b, tempo_a, tempo_b) -> Column:
    """Rule-based similarity of a pair, clamped to [0, 1]."""
    related = F.lit(False)
    for x, y in vocab.RELATED_LABELS:
        related = related | ((label_a == x) & (label_b == y))
    base = F.when(label_a == label_b, 0.8).when(related, 0.6).otherwise(0.2)
    gap = F.abs(tempo_a - tempo_b)
    bonus = (
        F.when(diff_a == diff_b, 0.1).otherwise(0.0)
        + F.when(energy_a == energy_b, 0.1).otherwise(0.0)
        + F.when(gap < 10, 0.1).when(gap > 30, -0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus))


def normalised_weights(weights: dict[str, Column]) -> dict[str, Column]:
    """w / sum(w); equal shares when the sum is 0."""
    total = sum(list(weights.values())[1:], list(weights.values())[0])
    share = 1.0 / len(weights)
    return {
        k: F.when(total == 0, share).otherwise(F.try_divide(w, total))
        for k, w in weights.items()
    }


def personal_weights(prefs: dict[str, Column]) -> dict[str, Column]:
    """Base weight times (1 + preference), scaled to sum to 1."""
    raised = {
        k: F.lit(w) * (1.0 + prefs[k]) if k in prefs else F.lit(w)
        for k, w in vocab.SPACE_WEIGHTS.items()
    }
    return normalised_weights(raised)
