"""Order inside a key without sorting a hot key in one task.

A key may hold a large share of all rows. Every function here splits a key
into coarse units of its order column, works inside (key, unit) and carries a
small per-unit summary across units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unit_offsets(df: DataFrame, keys: list[str], unit: str) -> DataFrame:
    counts = df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).drop("_cnt")


def dense_index(
    df: DataFrame,
    keys: list[str],
    order: list,
    unit: Column,
    name: str = "idx",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """0-based position of each row in its key, by `order`.

    `unit` is a coarse bucket that never decreases along `order`. Keys of at
    most `hot_rows` rows are numbered by one window. Larger keys are numbered
    per unit plus the offset of the earlier units; how they are told apart is
    left to the planner, which knows the size of their list. As only
    they use it, the unit may be fine; a struct of leading order columns works.
    """
    rank = F.row_number()
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
        hot = sizes.where(F.col("_cnt") > hot_rows).select(*keys)
        plain = df.join(hot, keys, "left_anti").withColumn(
            name, rank.over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
        )
        split = df.join(hot, keys, "left_semi")
    else:
        plain, split = None, df
    split = split.withColumn("_unit", unit)
    offsets = _unit_offsets(split, keys, "_unit")
    inside = Window.partitionBy(*keys, "_unit").orderBy(*order)
    numbered = (
        split.join(offsets, [*keys, "_unit"])
        .withColumn(name, F.col("_off") + rank.over(inside) - 1)
        .drop("_off", "_unit")
    )
    return numbered if plain is None else plain.unionByName(numbered)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    unit: Column,
    carry: list[str],
    before: str = "prev",
    after: str = "next",
) -> DataFrame:
    """Structs of the previous and next row in the key (null at the ends)."""
    row = F.struct(*order, *carry)
    base = df.withColumn("_unit", unit).withColumn("_row", row)
    ends = base.groupBy(*keys, "_unit").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_unit")
    ends = ends.select(
        *keys, "_unit",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_unit").orderBy(*order)
    return (
        base.join(ends, [*keys, "_unit"])
        .withColumn(before, F.coalesce(F.lag("_row").over(inside), F.col("_before")))
        .withColumn(after, F.coalesce(F.lead("_row").over(inside), F.col("_after")))
        .drop("_unit", "_row", "_before", "_after")
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], unit: Column, values: dict[str, Column]
) -> DataFrame:
    """Sum of each value over all rows up to and including this one."""
    base = df.withColumn("_unit", unit)
    for name, value in values.items():
        base = base.withColumn(name, value)
    totals = base.groupBy(*keys, "_unit").agg(*[F.sum(n).alias(f"_t_{n}") for n in values])
    past = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_unit", *[F.coalesce(F.sum(f"_t_{n}").over(past), F.lit(0)).alias(f"_c_{n}") for n in values]
    )
    inside = (
        Window.partitionBy(*keys, "_unit").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = base.join(carried, [*keys, "_unit"])
    for n in values:
        out = out.withColumn(n, F.sum(n).over(inside) + F.col(f"_c_{n}"))
    return out.drop("_unit", *[f"_c_{n}" for n in values])


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 4096
) -> DataFrame:
    """Linear-interpolated quantiles per key, equal to sorting the whole key.

    Equal values are counted first, so copies cost one row. Distinct values
    fall into equal-width buckets between the minimum and maximum of the key;
    ranks are bucket offsets plus a running count inside the bucket.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = [F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n")]
    if keys:
        placed = counted.join(counted.groupBy(*keys).agg(*ends), keys)
    else:
        span = counted.agg(*ends).select(F.struct("_lo", "_hi", "_n")).scalar()
        placed = counted.withColumn("_span", span).select("*", "_span.*").drop("_span")
    placed = placed.withColumn(
        "_b",
        F.coalesce(
            F.least(
                F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets),
                F.lit(buckets - 1),
            ),
            F.lit(0),
        ),
    )
    filled = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = filled.select(*keys, "_b", F.coalesce(F.sum("_bc").over(past), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offs, [*keys, "_b"]).withColumn("_end", F.col("_off") + F.sum("_c").over(upto))
    # The value covers positions [_end - _c, _end - 1].
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        start, stop = F.col("_end") - F.col("_c"), F.col("_end") - 1

        def at(k):
            return F.max(F.when((start <= k) & (k <= stop), F.col(value)))

        frac = F.max(pos - lo)
        aggs.append((at(lo) * (1 - frac) + at(hi) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
