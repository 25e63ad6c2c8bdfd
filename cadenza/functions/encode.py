"""Spaces of the unified item and request vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors, vocab


def md5_bucket(text: Column, n: int) -> Column:
    """Stable bucket in [0, n) from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(n)


def md5_unit(text: Column) -> Column:
    """Stable number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def number_space(value: Column, low: float, high: float, n: int = vocab.NUMBER_DIM) -> Column:
    """Sinusoids of the value scaled to [-1, 1], not clipped."""
    v = (value - low) / (high - low) * 2.0 - 1.0
    return F.array(
        *[
            (F.sin if i % 2 == 0 else F.cos)(F.lit((i + 1) * math.pi / n) * v)
            for i in range(n)
        ]
    )


def energy_space(level: Column) -> Column:
    """Alphabetical soft one-hot: high, low, medium; neighbours share weight."""
    return F.array(
        F.when(level == "high", 1.0).when(level == "medium", 0.3).otherwise(0.0),
        F.when(level == "low", 1.0).when(level == "medium", 0.3).otherwise(0.0),
        F.when(level == "medium", 1.0).when(level.isin("low", "high"), 0.2).otherwise(0.0),
    )


def role_space(role: Column) -> Column:
    """Alphabetical one-hot: both, follow_focus, lead_focus."""
    return F.array(*[F.when(role == r, 1.0).otherwise(0.0) for r in sorted(vocab.ROLES)])


def hashed_spots(item: Column, n: int = vocab.TRANSITION_DIM) -> Column:
    """The position that an id sets for each seed."""
    return F.array(*[md5_bucket(F.concat(item.cast("string"), F.lit(str(seed))), n).cast("int") for seed in vocab.TRANSITION_SEEDS])


def text_positions(text: Column, n: int = vocab.TEXT_DIM) -> Column:
    """Positions set by the text hash plus the codes of its first ten characters.

    The encoder is defined on ten characters; the hash covers the whole text.
    """
    codes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(10), F.length(text))),
        lambda i: F.ascii(F.substring(text, i, F.lit(1))),
    )
    spots = vectors.let(
        md5_bucket(text, n),
        lambda base: F.array_distinct(F.transform(codes, lambda c: ((base + c) % F.lit(n)).cast("int"))),
    )
    return F.when(F.length(text) > 0, spots).otherwise(F.array().cast("array<int>"))


def text_space(text: Column, n: int = vocab.TEXT_DIM) -> Column:
    return vectors.multi_hot(text_positions(text, n), n)


def unified(text, tempo, difficulty_rank, energy, role, transition, weights: dict) -> Column:
    """Six weighted spaces side by side: 384 + 8 + 8 + 3 + 3 + 64 = 470."""
    spaces = {
        "text": text,
        "tempo": number_space(tempo, *vocab.TEMPO_SPAN),
        "difficulty": number_space(difficulty_rank, *vocab.DIFFICULTY_SPAN),
        "energy": energy_space(energy),
        "role": role_space(role),
        "transition": transition,
    }
    return F.concat(*[vectors.scaled(v, weights[k]) for k, v in spaces.items()])
