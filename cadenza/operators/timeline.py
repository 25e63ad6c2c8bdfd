"""Timed slots and quality of ordered sequences of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, scores, vocab
from .graph import CLASS, compatible
from .ordering import running_totals
from .series import haloed, own


def fixed_slots(seqs: DataFrame, ids: str, target: str, seconds: float = 8.0, least: float = 4.0, most: int = 101) -> DataFrame:
    """Slots of equal length cycling through the items; a last slot below `least` is dropped.

    There are at most `most` slots, so `ids` needs the first `most` items only; `n_items` counts all of them.
    """
    whole = F.floor(F.col(target) / seconds)
    rest = F.col(target) - whole * seconds
    n = F.least(F.lit(most), whole + F.when(rest >= least, 1).otherwise(0)).cast("int")
    s = seqs.withColumn("_n", n).where("_n > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return s.withColumns({
        "item_id": F.get(ids, (F.col("slot") % F.col("n_items")).cast("int")),
        "start": F.col("slot") * seconds, "seconds": F.least(F.lit(seconds), F.col(target) - F.col("slot") * seconds)}).drop("_n", "n_items", ids, target)


def natural_slots(slots: DataFrame, keys: list[str], order: str, seconds: str, target: float) -> DataFrame:
    """Own durations in order, up to the first slot that would overflow the target; `order` counts the rows of a sequence from 0."""
    s = running_totals(slots, keys, [order], F.floor(F.col(order) / 1024), {"end": F.col(seconds)})
    return s.where(F.col("end") <= target).withColumn("start", F.col("end") - F.col(seconds))


def beat_slots(songs: DataFrame, beats: str, tempo: Column, items: int, target: float | None = None) -> DataFrame:
    """Every four beats, 6 to 15 seconds, extrapolated past the last beat; stops at the target.

    `n` counts all beats of a song; the array needs the first 4 * items + 1 of them.
    """
    n = F.col("n")
    s = songs.where(n > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))
    i = F.col("slot") * 4
    gap = 60.0 / tempo
    start = F.when(i < n, F.get(beats, i)).otherwise(F.get(beats, n - 1) + (i - n + 1) * gap)
    j = F.least(i + 4, n - 1)
    length = F.when((j > i) & (j < n), F.get(beats, j) - start).otherwise(gap * 4)
    s = s.withColumn("start", start).withColumn("seconds", F.greatest(F.lit(6.0), F.least(F.lit(15.0), length)))
    if target is not None:
        done = (F.col("start") + F.col("seconds") >= target).cast("int")
        keys = [c for c in songs.columns if c not in (beats, "n")]
        before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("_done", F.coalesce(F.max(done).over(before), F.lit(0))).where("_done = 0").drop("_done")
    return s.drop(beats)


def with_next(slots: DataFrame, keys: list[str], cols: list[str], order: str = "pos") -> DataFrame:
    """Columns of the next row; `order` counts the rows of a sequence from 0."""
    w = Window.partitionBy(*keys, "_u").orderBy(order)
    return own(haloed(slots, 0, 1, order).withColumns({f"next_{c}": F.lead(c).over(w) for c in cols}), order)


def edge_score() -> Column:
    """1 for a compatible next item, else the mean of level and difficulty compatibility."""
    a, b = {c: F.col(c) for c in CLASS}, {c: F.col(f"next_{c}") for c in CLASS}
    gap = F.abs(scores.level_rank(F.col("difficulty")) - scores.level_rank(F.col("next_difficulty")))
    other = (scores.level_compat(F.col("energy"), F.col("next_energy")) + scores.difficulty_compat(F.lit("intermediate"), gap)) / 2.0
    linked = compatible(a, b) & (F.col("item_id") != F.col("next_item_id"))
    return F.when(F.col("next_label").isNotNull(), F.when(linked, 1.0).otherwise(other))


def sequence_metrics(slots: DataFrame, keys: list[str]) -> DataFrame:
    """All per-sequence measures from one pass: diversity, balance, flow, steps, smoothness, bands."""
    d = with_next(slots, keys, ["item_id", *CLASS])
    d = d.withColumns({
        "kind": labels.type_of(F.col("label")), "edge": edge_score(),
        "step": F.when(F.col("next_label").isNotNull(), scores.step_score(F.col("difficulty"), F.col("next_difficulty"), down=0.8, jump=0.6, worst=0.4)),
        "bigram": F.when(F.col("next_label").isNotNull(), F.concat("label", F.lit(">"), "next_label"))})
    n = F.count(F.lit(1))
    kinds = F.size(F.collect_set("kind"))

    def count_of(words):
        return F.array(*[F.count_if(F.col("label") == x) for x in words])

    g = d.groupBy(*keys).agg(
        n.alias("n"), kinds.alias("n_types"), F.size(F.collect_set("label")).alias("n_labels"),
        F.when(n <= 1, 0.0).otherwise(kinds / n * 0.7 + F.least(F.lit(1.0), F.stddev_pop("similarity") * 2) * 0.3).alias("diversity"),
        F.filter(count_of(vocab.LABELS), lambda c: c > 0).alias("_counts"),
        F.size(F.collect_set("bigram")).alias("_big"), F.count("bigram").alias("_bigs"),
        F.coalesce(F.avg("edge"), F.lit(0.0)).alias("edge_mean"), F.coalesce(F.avg("step"), F.lit(1.0)).alias("progression"),
        F.avg("similarity").alias("similarity_mean"), F.sum("seconds").alias("seconds"), F.avg("tempo").alias("tempo_mean"),
        *[F.count_if(F.col("difficulty") == x).alias(f"n_{x}") for x in vocab.DIFFICULTIES])
    return g.withColumns({
        "balance": 1.0 - (F.array_max("_counts") - F.array_min("_counts")) / F.col("n"),
        "flow": F.coalesce(F.try_divide(F.col("_big"), F.col("_bigs")), F.lit(0.0)),
        "repetitive": ~(F.col("n_labels") > F.col("n") * 0.4)}).drop("_counts", "_big", "_bigs")


def majority_band() -> Column:
    """Most frequent difficulty; ties go to the easier one."""
    return F.array_max(F.array(*[
        F.struct(F.col(f"n_{x}").alias("n"), F.lit(-i).alias("r"), F.lit(x).alias("band")) for i, x in enumerate(vocab.DIFFICULTIES)]))["band"]
