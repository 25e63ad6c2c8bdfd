"""Vector columns (array<double>) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, _zero(), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda acc, x: acc + x * x))


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda acc, x: acc + x)


def vec_mean(v: Column) -> Column:
    return F.try_divide(vec_sum(v), F.size(v))


def vec_var(v: Column) -> Column:
    """Population variance of the entries."""
    return let(
        vec_mean(v),
        lambda m: F.try_divide(
            F.aggregate(v, _zero(), lambda acc, x: acc + (x - m) * (x - m)), F.size(v)
        ),
    )


def scaled(v: Column, factor) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(v, lambda x: x * factor)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    return let(
        v,
        lambda w: let(
            norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)
        ),
    )


def clean(v: Column) -> Column:
    """NaN becomes 0, positive and negative infinity become 1 and -1."""
    return F.transform(
        v,
        lambda x: F.when(F.isnan(x), 0.0)
        .when(x == float("inf"), 1.0)
        .when(x == float("-inf"), -1.0)
        .otherwise(x),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def rescaled_cosine(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 over the common length, 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.coalesce((F.try_divide(dot(a, b), norm(a) * norm(b)) + 1.0) / 2.0, F.lit(0.0))


def pad_to(v: Column, n: int) -> Column:
    """Zeros up to n entries, or the first n entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def multi_hot(positions: Column, n: int) -> Column:
    """n entries, 1 at each listed position."""
    return let(
        positions,
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.when(F.array_contains(p, i), 1.0).otherwise(0.0),
        ),
    )
