"""Explanations, descriptions, tags and request parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .labels import any_of


def score_explanation(audio, gap, energy, energy_match, difficulty, difficulty_match) -> Column:
    near = F.round(gap, 1).cast("decimal(10,1)").cast("string")
    return F.struct(
        F.when(audio > 0.8, "Excellent musical match")
        .when(audio > 0.6, "Good musical compatibility")
        .when(audio > 0.4, "Moderate musical fit")
        .otherwise("Limited musical compatibility").alias("audio"),
        F.when(gap == 0, F.lit("Perfect tempo match"))
        .when(gap <= 5, F.concat(F.lit("Very close tempo (±"), near, F.lit(" BPM)")))
        .when(gap <= 10, F.concat(F.lit("Good tempo fit (±"), near, F.lit(" BPM)")))
        .otherwise(F.concat(F.lit("Tempo stretch needed (±"), near, F.lit(" BPM)"))).alias("tempo"),
        F.when(energy_match, "Perfect energy level match")
        .when(energy > 0.6, "Compatible energy level")
        .otherwise("Different energy level").alias("energy"),
        F.when(difficulty_match, "Perfect difficulty match")
        .when(difficulty > 0.7, "Compatible difficulty level")
        .otherwise("Different difficulty level").alias("difficulty"),
    )


def match_explanation(similarity, tempo_gap, energy, label, notes) -> Column:
    whole = F.round(tempo_gap, 0).cast("long").cast("string")
    quality = (
        F.when(similarity > 0.8, "Excellent").when(similarity > 0.6, "Good")
        .when(similarity > 0.4, "Moderate").otherwise("Basic")
    )
    tempo = (
        F.when(tempo_gap <= 5, F.lit("perfect tempo match"))
        .when(tempo_gap <= 10, F.concat(F.lit("close tempo (±"), whole, F.lit(" BPM)")))
        .otherwise(F.concat(F.lit("tempo adaptation needed (±"), whole, F.lit(" BPM)")))
    )
    head = F.concat(quality, F.lit(" match with "), tempo, F.lit(", "), energy, F.lit(" energy "), label)
    return F.when(F.coalesce(F.length(notes), F.lit(0)) > 0, F.concat(head, F.lit(" - "), notes)).otherwise(head)


def song_description(tempo, centroid, percussive, difficulty, energy, style=None) -> Column:
    pace = F.when(tempo < 110, "slow").when(tempo > 130, "fast").otherwise("medium tempo")
    colour = F.when(centroid > 2000, "bright").otherwise("warm")
    rhythm = F.when(percussive > 0.1, "strong rhythm").otherwise("gentle rhythm")
    if style is None:
        head = F.concat(energy, F.lit(" energy "), difficulty)
    else:
        phrase = F.when(style.isNull(), "versatile")
        for name, words in vocab.STYLE_PHRASES.items():
            phrase = phrase.when(style == name, words)
        head = F.concat(phrase.otherwise("versatile"), F.lit(" "), difficulty, F.lit(" "), energy, F.lit(" energy"))
    return F.concat(
        head, F.lit(f" {vocab.GENRE} with "), pace, F.lit(" "), colour, F.lit(" sound and "), rhythm
    )


def _keyword_level(text: Column, rules) -> Column:
    out = None
    for value, words in rules:
        hit = any_of(text, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def parse_request(text: Column, song_tempo: Column) -> Column:
    """Level, role, types, tempo and weight preset named in a request text."""
    low = F.lower(text)
    role = (
        F.when(low.contains("lead") & ~low.contains("follow"), "lead_focus")
        .when(low.contains("follow") & ~low.contains("lead"), "follow_focus")
        .otherwise("both")
    )
    types = F.array_compact(
        F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in vocab.REQUEST_TYPE_WORDS])
    )
    named = F.nullif(F.regexp_extract(low, r"([0-9]+)\s*bpm", 1), F.lit(""))
    return F.struct(
        _keyword_level(text, vocab.REQUEST_DIFFICULTY).alias("difficulty"),
        _keyword_level(text, vocab.REQUEST_ENERGY).alias("energy"),
        role.alias("role"),
        types.alias("types"),
        F.coalesce(named.try_cast("double"), song_tempo).alias("tempo"),
        _keyword_level(text, vocab.REQUEST_WEIGHT_WORDS).alias("preset"),
    )


def search_tags(tempo, mean_energy, rhythm, syncopation, types: Column, mode: Column) -> Column:
    head = F.array(
        F.when(tempo < 100, F.lit("slow")).when(tempo > 140, F.lit("fast")).otherwise(F.lit("medium_tempo")),
        F.when(mean_energy > 0.3, F.lit("high_energy")).when(mean_energy < 0.15, F.lit("low_energy"))
        .otherwise(F.lit("medium_energy")),
    )
    tail = F.array_compact(
        F.array(
            F.concat(F.lit("quality_"), mode),
            F.when(rhythm > 0.7, F.lit("strong_rhythm")),
            F.when(syncopation > 0.6, F.lit("syncopated")),
        )
    )
    return F.concat(head, types, tail)


def advice(alignment: Column, diversity: Column, flow: Column) -> Column:
    """Advice rows (type, priority) for one sequence."""
    return F.array_compact(
        F.array(
            F.when(alignment < 0.8, F.struct(F.lit("tempo").alias("kind"), F.lit("high").alias("priority"))),
            F.when(diversity < 0.5, F.struct(F.lit("diversity").alias("kind"), F.lit("medium").alias("priority"))),
            F.when(flow < 0.6, F.struct(F.lit("flow").alias("kind"), F.lit("medium").alias("priority"))),
        )
    )


def tempo_advice(tempo: Column, rhythm: Column, syncopation: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(tempo < 110, F.lit("Consider slower, more dramatic moves for this tempo"))
            .when(tempo > 140, F.lit("Focus on quick, energetic moves for this fast tempo"))
            .otherwise(F.lit(f"Perfect tempo range for classic {vocab.GENRE} moves")),
            F.when(rhythm > 0.8, F.lit("Strong rhythm - emphasize beat-matching moves")),
            F.when(syncopation > 0.7, F.lit("High syncopation - incorporate complex timing variations")),
        )
    )
