"""Category caps, round robin and type limits over ranked candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encode import md5_unit


def capped_topk(
    ranked: DataFrame, key: str, category: str, k: int, mode: str = "ordered", seed: int = 0, item: str = "item_id"
) -> DataFrame:
    """k per key, first at most max(1, k/4) per category in rank order, then a fill.

    The fill takes the rest in rank order, as a rank-weighted sample without
    replacement, or as a uniform sample of its better half. `ranked` holds a
    bounded candidate list per key with a `rank` column.
    """
    cap = max(1, k // 4)
    by_cat = Window.partitionBy(key, category).orderBy("rank")
    by_rank = Window.partitionBy(key).orderBy("rank")
    marked = ranked.withColumn("_in_cat", F.row_number().over(by_cat))
    # Capped picks stop at k: the first k rows inside their cap.
    capped = F.col("_in_cat") <= cap
    marked = marked.withColumn(
        "_pick", capped & (F.sum(capped.cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) <= k)
    )
    left = Window.partitionBy(key, "_pick").orderBy("rank")
    marked = marked.withColumn("_pos", F.row_number().over(left)).withColumn(
        "_left", F.count(F.lit(1)).over(Window.partitionBy(key, "_pick"))
    )
    u = drawn_number(seed, F.col(key), F.col(item))
    if mode == "ordered":
        fill: Column = F.col("_pos").cast("double")
    elif mode == "weighted":
        fill = -F.log(F.greatest(u, F.lit(1e-12))) * F.col("_pos")
    elif mode == "sample":
        fill = F.when(F.col("_pos") <= F.floor(F.col("_left") / 2), u).otherwise(F.lit(None))
    else:
        raise ValueError(mode)
    fill = F.when(F.col("_pick"), F.col("_pos").cast("double")).otherwise(fill)
    order = Window.partitionBy(key).orderBy(F.desc("_pick"), F.asc_nulls_last("_fill"), "rank")
    out = (
        marked.withColumn("_fill", fill)
        .withColumn("_slot", F.row_number().over(order))
        .where((F.col("_slot") <= k) & F.col("_fill").isNotNull())
    )
    final = Window.partitionBy(key).orderBy("rank")
    return out.withColumn("place", F.row_number().over(final).cast("long")).drop("_in_cat", "_pick", "_pos", "_left", "_fill", "_slot")


def drawn_number(seed: int, key: Column, item: Column) -> Column:
    """Number in [0, 1) that a seeded draw gives an item of a key."""
    return md5_unit(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), item.cast("string")))


def capped_places(c, k: int, mode: str = "ordered") -> np.ndarray:
    """As `capped_topk`, places in lists (`folds.Lists`) in rank order: `label` is the category, `u` the drawn number of the weighted form."""
    width, cap = c.there.shape[1], max(1, k // 4)
    earlier = np.tri(width, k=-1, dtype=bool)
    in_cat = ((c.label[:, :, None] == c.label[:, None, :]) & earlier & c.there[:, None, :]).sum(axis=2)
    capped = c.there & (in_cat < cap)
    pick = capped & (np.cumsum(capped, axis=1) <= k)
    rest = c.there & ~pick
    fill = np.cumsum(rest, axis=1).astype(np.float64)
    if mode == "weighted":
        fill = -np.log(np.maximum(c.u, 1e-12)) * fill
    order = np.argsort(np.where(pick, -1.0, np.where(rest, fill, np.inf)), axis=1, kind="stable")[:, :k]
    chosen = np.sort(np.where(np.take_along_axis(c.there, order, axis=1), order, width), axis=1)
    return np.where(chosen < width, chosen, -1)


def round_robin(df: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """n rows, one per category in first-seen order, then a second round, and so on."""
    seen = df.groupBy(category).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(category).orderBy(order)
    # At most n rows per category can be picked; the rank filter is pushed below the shuffle.
    few = df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n)
    return few.join(seen, category).orderBy("round", "_first").limit(n).drop("_first").withColumn("round", F.col("round").cast("long"))


def best_per_type(ranked: DataFrame, key: str, kind: str, score: str, max_repeats: int, tie: str) -> DataFrame:
    """Per key the best rows of each type, at most `max_repeats` of one type."""
    w = Window.partitionBy(key, kind).orderBy(F.desc(score), tie)
    return ranked.withColumn("type_rank", F.row_number().over(w)).where(F.col("type_rank") <= max_repeats).withColumn(
        "type_rank", F.col("type_rank").cast("long"))


def diversity_score(df: DataFrame, keys: list[str], kind: str, score: str, name: str = "diversity") -> DataFrame:
    """0.7 * types / n + 0.3 * min(1, 2 * std(score)); 0 for a single row."""
    n = F.count(F.lit(1))
    types = F.size(F.collect_set(kind))  # types come from a fixed vocabulary
    value = types / n * 0.7 + F.least(F.lit(1.0), F.stddev_pop(score) * 2) * 0.3
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n <= 1, 0.0).otherwise(value).alias(name))
