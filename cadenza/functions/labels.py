"""Labels, categories, ordinal codes and rule checks of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    low = F.lower(text)
    out = None
    for word, value in rules:
        out = F.when(low.contains(word), value) if out is None else out.when(low.contains(word), value)
    return out


def category_of(label: Column) -> Column:
    return _first_match(label, vocab.CATEGORY_RULES)


def type_of(label: Column) -> Column:
    return _first_match(label, vocab.TYPE_RULES).otherwise("other")


def any_of(text: Column, words: list[str]) -> Column:
    """Text holds at least one of the words."""
    low = F.lower(text)
    out = low.contains(words[0])
    for word in words[1:]:
        out = out | low.contains(word)
    return out


def describe(label: Column, energy: Column, difficulty: Column, notes: Column) -> Column:
    head = F.concat_ws(" ", difficulty, energy, F.lit("energy"), F.replace(label, F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(F.length(notes), F.lit(0)) > 0, F.concat(head, F.lit(" - "), notes)).otherwise(head)


def schema_errors(c: dict[str, Column]) -> Column:
    """Names of the broken rules of a catalogue row, in rule order."""
    required = ["item_id", "label", "energy", "difficulty", "tempo", "role"]
    rules = [(f"missing_{k}", c[k].isNull()) for k in required]
    rules += [
        ("energy", ~c["energy"].isin(vocab.ENERGIES)),
        ("difficulty", ~c["difficulty"].isin(vocab.DIFFICULTIES)),
        ("role", ~c["role"].isin(vocab.ROLES)),
        ("tempo", ~c["tempo"].between(vocab.MIN_TEMPO, vocab.MAX_TEMPO)),
        ("duration", ~c["duration"].between(vocab.MIN_CLIP_SECONDS, vocab.MAX_CLIP_SECONDS)),
        ("tempo_range", c["tempo_hi"] < c["tempo_lo"]),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def annotation_notes(tempo: Column, notes: Column, label: Column, difficulty: Column) -> Column:
    """Issues and warnings of one annotated row."""
    return F.array_compact(
        F.array(
            F.when(~tempo.between(vocab.MIN_TEMPO, vocab.MAX_TEMPO), F.lit("issue:tempo_out_of_range")),
            F.when(F.coalesce(F.length(F.trim(notes)), F.lit(0)) < 10, F.lit("warning:notes_brief")),
            F.when(
                any_of(label, vocab.ADVANCED_LABELS) & (difficulty == "beginner"),
                F.lit("warning:advanced_label_for_beginner"),
            ),
        )
    )


def media_problems(duration, width, height, fps) -> Column:
    return F.array_compact(
        F.array(
            F.when(duration < 5, F.lit("too_short")),
            F.when(duration > 20, F.lit("too_long")),
            F.when((width < 640) | (height < 480), F.lit("low_resolution")),
            F.when(fps < 24, F.lit("low_frame_rate")),
        )
    )


def predicted_category(direction: Column, complexity: Column, label: Column) -> Column:
    low = F.lower(label)
    level = direction == "horizontal"
    return (
        F.when(level & low.contains("cross"), "cross_body_lead")
        .when(level & (low.contains("forward") | low.contains("backward")), "forward_backward")
        .when((complexity > 0.7) & low.contains("combination"), "combination")
        .when((complexity > 0.7) & low.contains("body_roll"), "body_roll")
        .when(low.contains("turn") & low.contains("right"), "lady_right_turn")
        .when(low.contains("turn") & low.contains("left"), "lady_left_turn")
        .when(low.contains("basic"), "basic_step")
    )


def predicted_difficulty(complexity: Column, difficulty_score: Column) -> Column:
    mean = (complexity + difficulty_score) / 2.0
    return F.when(mean < 0.3, "beginner").when(mean < 0.7, "intermediate").otherwise("advanced")


def predicted_energy(speed: Column, intensity: Column) -> Column:
    mixed = speed * 0.6 + intensity * 0.4
    return F.when(mixed < 0.02, "low").when(mixed < 0.05, "medium").otherwise("high")


def request_errors(c: dict[str, Column]) -> Column:
    """Broken rules of a request row; null means the field was not given."""
    bad_types = F.array_except(c["types"], F.array(*[F.lit(t) for t in vocab.REQUEST_TYPES]))
    lo, hi = F.get(c["tempo_range"], 0), F.get(c["tempo_range"], 1)
    pair = F.size(c["tempo_range"]) == 2
    rules = [
        ("difficulty", ~c["difficulty"].isin(vocab.DIFFICULTIES)),
        ("energy", ~c["energy"].isin(vocab.ENERGIES)),
        ("quality_mode", ~c["quality_mode"].isin("fast", "balanced", "high_quality")),
        ("max_duration", ~c["max_duration"].between(30, 1200)),
        ("min_duration", ~c["min_duration"].between(10, 300)),
        ("role", ~c["role"].isin(vocab.ROLES)),
        ("types", F.size(bad_types) > 0),
        ("tempo_range_size", ~pair),
        ("tempo_range_bounds", pair & ((lo < 80) | (hi > 180))),
        ("tempo_range_order", pair & (lo >= hi)),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
