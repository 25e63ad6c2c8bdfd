"""Counts, facets, balance and numeric profiles of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles


def facet_counts(df: DataFrame, facets: list[str], measures: list[Column]) -> DataFrame:
    """One pass over the table: a row per facet value and one overall row."""
    keys = [F.col(f) for f in facets]
    grouped = df.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"), *measures
    )
    width = len(facets)
    # Bit i of the grouping id is 0 for the facet that is present.
    name = F.lit("all")
    for i, f in enumerate(facets):
        present = F.col("_gid") == F.lit((2 ** width - 1) ^ (1 << (width - 1 - i)))
        name = F.when(present, F.lit(f)).otherwise(name)
    value = F.coalesce(*[F.col(f).cast("string") for f in facets], F.lit("all"))
    return grouped.select(name.alias("facet"), value.alias("value"), *[c for c in grouped.columns if c not in (*facets, "_gid")])


def balance_score(counts: DataFrame, n: str = "n", by: list[str] | None = None, name: str = "balance") -> DataFrame:
    """Shannon entropy of the counts over log2 of their number; 1 for one group or none."""
    n_col = F.col(n).cast("double")
    # H = log2(N) - sum(n * log2 n) / N, from two sums in one pass.
    total, groups = F.sum(n_col), F.count(F.lit(1))
    entropy = F.log2(total) - F.sum(n_col * F.log2(n_col)) / total
    score = F.when(groups <= 1, 1.0).otherwise(F.try_divide(entropy, F.log2(groups)))
    return counts.where(n_col > 0).groupBy(*(by or [])).agg(score.alias(name))


def spread(value, prefix: str = "") -> list[Column]:
    """Mean, population std, min and max."""
    return [
        F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}std"),
        F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"),
    ]


def share(cond: Column) -> Column:
    """Percentage of rows that hold."""
    return F.try_divide(F.count_if(cond) * 100.0, F.count(F.lit(1)))


def tempo_distribution(df: DataFrame, tempo: str) -> DataFrame:
    """Count, spread, median, share in 90-150 and four bins, in one row."""
    t = F.col(tempo)
    median = exact_quantiles(df, [], tempo, {"median": 0.5}).select("median").scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n"), *spread(t),
        share(t.between(90, 150)).alias("in_range_pct"),
        F.count_if(t.between(90, 110)).alias("slow"),
        F.count_if((t > 110) & (t <= 130)).alias("medium"),
        F.count_if((t > 130) & (t <= 150)).alias("fast"),
        F.count_if((t < 90) | (t > 150)).alias("outside"),
    ).withColumn("median", median)


def child_histogram(children: DataFrame, parent: str) -> DataFrame:
    """Parents by number of children, with a row for every count between min and max."""
    sizes = children.groupBy(parent).agg(F.count(F.lit(1)).alias("children"))
    hist = sizes.groupBy("children").agg(F.count(F.lit(1)).alias("parents"))
    dense = hist.agg(F.min("children").alias("lo"), F.max("children").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("children")
    )
    return dense.join(hist, "children", "left").select("children", F.coalesce("parents", F.lit(0)).alias("parents"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
