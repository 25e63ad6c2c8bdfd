"""Compatibility graph kept as edges between attribute classes.

Whether two items are compatible depends only on (label, difficulty, energy),
a fixed vocabulary of at most 108 combinations. The graph is stored as class
counts and class edges; degrees and neighbour features of an item follow from
these without listing item pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, vocab

CLASS = ["label", "difficulty", "energy"]


def compatible(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Item a may be followed by item b (label, difficulty, energy each)."""
    near = (scores.level_gap(a["energy"], b["energy"]) <= 1) | (scores.level_gap(a["difficulty"], b["difficulty"]) <= 1)
    crossing = a["label"].isin("cross_body_lead", "double_cross_body_lead")
    turning = ~crossing & a["label"].contains("turn") & (a["label"] != "basic_step")
    easy_next = b["label"].contains("turn") | (b["label"] == "basic_step")
    return near | (a["label"] == "basic_step") | ((crossing | turning) & easy_next)


def all_classes() -> Column:
    return F.array(*[
        F.struct(F.lit(lab).alias("label"), F.lit(d).alias("difficulty"), F.lit(e).alias("energy"))
        for lab in vocab.LABELS for d in vocab.DIFFICULTIES for e in vocab.ENERGIES
    ])


def class_edges(items: DataFrame) -> DataFrame:
    """(class of a) -> (class of b) with the number of items in b's class."""
    counts = items.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))
    to = {c: F.col(c) for c in CLASS}
    sources = F.filter(all_classes(), lambda s: compatible({c: s[c] for c in CLASS}, to))
    wide = counts.select(F.explode(sources).alias("a"), *[F.col(c).alias(f"to_{c}") for c in CLASS], F.col("n").alias("to_n"))
    wide = wide.select(*[F.col(f"a.{c}").alias(c) for c in CLASS], *[f"to_{c}" for c in CLASS], "to_n")
    return wide.join(counts, CLASS).withColumnRenamed("n", "from_n")


def degrees(items: DataFrame, item_id: str) -> DataFrame:
    """Number of items compatible with each item, itself excluded."""
    # A class is always compatible with itself, so one is taken off.
    per_class = class_edges(items).groupBy(*CLASS).agg((F.sum("to_n") - 1).alias("n_compatible"))
    return items.select(item_id, *CLASS).join(per_class, CLASS)


def with_neighbour_spots(items: DataFrame, bits: Column, name: str) -> DataFrame:
    """The items, with the sorted positions set by any compatible other item.

    `bits` are the positions an item sets. Class totals are summed over
    compatible classes; a position that one item alone sets does not count
    for that item itself.
    """
    own = items.withColumn("_own", F.array_distinct(bits))
    totals = own.select(*CLASS, F.explode("_own").alias("_bit")).groupBy(*CLASS, "_bit").agg(F.count(F.lit(1)).alias("_c"))
    to = {c: F.col(c) for c in CLASS}
    sources = F.filter(all_classes(), lambda s: compatible({c: s[c] for c in CLASS}, to))
    spread = totals.select(F.explode(sources).alias("a"), "_bit", "_c")
    summed = spread.groupBy(*[F.col(f"a.{c}").alias(c) for c in CLASS], "_bit").agg(F.sum("_c").alias("_c"))
    # At most one entry for each position and class, of which there are 108.
    table = summed.groupBy(*CLASS).agg(
        F.collect_list(F.when(F.col("_c") > 1, F.col("_bit"))).alias("_many"), F.collect_list(F.when(F.col("_c") == 1, F.col("_bit"))).alias("_single"))
    spots = F.array_sort(F.concat("_many", F.array_except("_single", "_own")))
    return own.join(F.broadcast(table), CLASS).withColumn(name, spots).drop("_own", "_many", "_single")
