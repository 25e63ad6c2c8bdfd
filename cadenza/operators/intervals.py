"""Nearest-in-time and window joins between two ordered tables of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_and_first(
    probes: DataFrame, points: DataFrame, keys: list[str], t: str, unit_of, carry: list[str]
) -> DataFrame:
    """Probe rows with the last point at or before and the first point at or after t.

    `unit_of(column)` gives a coarse time unit. Work is grouped by (key, unit);
    the last and first point of the other units come from a per-unit summary,
    so neither a hot key nor a dense stretch produces pairs.
    """
    point_row = F.struct(F.col(t), *carry)
    a = probes.withColumn("_point", F.lit(None).cast(_row_type(points, t, carry))).withColumn("_probe", F.lit(True))
    b = points.select(*keys, t, point_row.alias("_point")).withColumn("_probe", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_unit", unit_of(F.col(t)))
    ends = both.groupBy(*keys, "_unit").agg(F.max("_point").alias("_mx"), F.min("_point").alias("_mn"))
    w = Window.partitionBy(*keys).orderBy("_unit")
    ends = ends.select(
        *keys, "_unit",
        F.max("_mx").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_mn").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    inside = Window.partitionBy(*keys, "_unit").orderBy(t)
    return (
        both.join(ends, [*keys, "_unit"])
        .withColumn(
            "before",
            F.coalesce(F.max("_point").over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.col("_earlier")),
        )
        .withColumn(
            "after",
            F.coalesce(F.min("_point").over(inside.rangeBetween(0, Window.unboundedFollowing)), F.col("_later")),
        )
        .where("_probe")
        .drop("_unit", "_point", "_probe", "_earlier", "_later")
    )


def _row_type(points: DataFrame, t: str, carry: list[str]) -> str:
    types = dict(points.dtypes)
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in [t, *carry]) + ">"


def nearest(probes, points, keys, t, unit_of, carry, name: str = "nearest") -> DataFrame:
    """Probe rows with the closest point; equal distances go to the earlier one."""
    both = last_and_first(probes, points, keys, t, unit_of, carry)
    back = F.abs(F.col(t) - F.col(f"before.{t}"))
    ahead = F.abs(F.col(f"after.{t}") - F.col(t))
    pick_back = F.col("after").isNull() | (back <= ahead)
    return (
        both.withColumn(name, F.when(pick_back, F.col("before")).otherwise(F.col("after")))
        .withColumn("gap", F.when(pick_back, back).otherwise(ahead))
        .drop("before", "after")
    )


def window_totals(
    probes: DataFrame,
    points: DataFrame,
    keys: list[str],
    t: str,
    unit_seconds: float,
    reach: float,
    totals: dict[str, Column],
) -> DataFrame:
    """Probe rows with sums over the points at most `reach` away in time.

    Points near the edge of a unit are copied to the neighbouring unit, so each
    (key, unit) is complete on its own; the frame slides inside it.
    """
    lo = F.floor((F.col(t) - reach) / unit_seconds)
    hi = F.floor((F.col(t) + reach) / unit_seconds)
    b = points.select(
        *keys, t, *[c.alias(f"_v_{n}") for n, c in totals.items()], F.explode(F.sequence(lo, hi)).alias("_unit")
    ).withColumn("_probe", F.lit(False))
    a = probes.withColumn("_unit", F.floor(F.col(t) / unit_seconds)).withColumn("_probe", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    ticks = F.round(F.col(t) * 1e6).cast("long")  # frames need whole numbers: microseconds
    width = round(reach * 1e6)
    w = Window.partitionBy(*keys, "_unit").orderBy(ticks).rangeBetween(-width, width)
    for n in totals:
        both = both.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0.0)))
    return both.where("_probe").drop("_unit", "_probe", *[f"_v_{n}" for n in totals])


def salted_interval_join(
    points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, salt: Column, salts: int = 16
) -> DataFrame:
    """Points joined to the few spans of their key that contain them.

    Spans are replicated over `salts` copies and points spread over them, so
    the points of a hot key are split. Each key must have few spans.
    """
    a = points.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    b = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_salt")
