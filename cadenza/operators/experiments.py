"""Weight grids, folds, traffic splits and paired comparisons."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import md5_bucket
from .ordering import dense_index

# Grid of the search: first and last value per weight, in this order (fixed values).
RANGES = {"audio": (0.1, 0.6), "tempo": (0.1, 0.4), "energy": (0.1, 0.4), "difficulty": (0.1, 0.4)}


def grid_ids(steps: int = 5, at_most: int = 100, seed: int = 0) -> list[int]:
    """Numbers of the chosen grid points: all, or those with the smallest md5."""
    ids = range(steps ** len(RANGES))
    if len(ids) <= at_most:
        return list(ids)
    return sorted(sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:at_most])


def grid_weights(config: Column, steps: int = 5) -> dict[str, Column]:
    """Normalised weights of a grid point, from its number."""
    raw = {}
    for place, (name, (lo, hi)) in enumerate(reversed(list(RANGES.items()))):
        digit = F.floor(config / steps**place) % steps
        raw[name] = lo + digit * (hi - lo) / (steps - 1)
    total = sum(list(raw.values())[1:], list(raw.values())[0])
    return {name: raw[name] / total for name in RANGES}


def with_configs(df: DataFrame, ids: list[int]) -> DataFrame:
    """Each row once per configuration; the list is short and fixed."""
    return df.withColumn("config", F.explode(F.array(*[F.lit(i) for i in ids])))


def contiguous_folds(df: DataFrame, order: list[str], unit: Column, k: int) -> DataFrame:
    """Fold number: n // k rows each in order, the rest goes to the last fold."""
    size = F.greatest(F.floor(df.agg(F.count(F.lit(1))).scalar() / k), F.lit(1))
    return dense_index(df, [], order, unit, name="_i").withColumn(
        "fold", F.least(F.floor(F.col("_i") / size), F.lit(k - 1)).cast("int")
    ).drop("_i")


def assign_version(user: Column, split: list[tuple[str, int]]) -> Column:
    """md5 bucket in [0, 100) against the running split; the first version otherwise."""
    bucket = md5_bucket(user.cast("string"), 100)
    out, upper = None, 0
    for version, percent in split:
        upper += percent
        hit = bucket < upper
        out = F.when(hit, version) if out is None else out.when(hit, version)
    return out.otherwise(split[0][0])


def paired_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Means, improvement in percent, t from the pooled population std, and 1 - t/4 clamped."""
    n = F.count(F.lit(1))
    base = df.agg(
        n.alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2.0).alias("pooled_std"),
    )
    t = F.try_divide(F.abs(F.col("mean_b") - F.col("mean_a")), F.col("pooled_std") * F.sqrt(F.lit(2.0) / F.col("n")))
    return base.select(
        "*",
        F.when(F.col("mean_a") > 0, (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100).otherwise(0.0).alias("improvement"),
        F.coalesce(t, F.lit(0.0)).alias("t"),
    ).withColumn(
        "significance_proxy",
        F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("t") / 4.0))).otherwise(0.5),
    )
