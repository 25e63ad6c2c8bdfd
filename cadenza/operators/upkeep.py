"""Keeping a catalogue: guarded append, patch, lookup, delete, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(old: DataFrame, new: DataFrame, key: str, order: str, valid: Column | None = None) -> DataFrame:
    """Old rows plus the new ones: valid, of a key that is not there yet, and the first of their key by `order`.

    `order` ranks the new rows and is not stored. The rest is rejected, as if the rows were added one by one.
    """
    good = new if valid is None else new.where(F.coalesce(valid, F.lit(False)))
    first = good.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), order).alias("_row"))
    fresh = first.join(old.select(key), key, "left_anti").select(key, "_row.*")
    return old.unionByName(fresh.select(*old.columns))


def patch(old: DataFrame, updates: DataFrame, key: str, order: str, valid: Column | None = None) -> DataFrame:
    """Rows with the non-null values of sparse patches laid over them; of several patches of a key the later ones win.

    A row that would not be `valid` afterwards stays as it was. Patches of unknown keys change nothing; `order` ranks the
    patches of a key.
    """
    fields = [c for c in updates.columns if c not in (key, order)]
    laid = updates.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_p_{c}") for c in fields])
    joined = old.join(laid, key, "left").withColumn("_old", F.struct(*old.columns))
    done = joined.withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields})
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    return done.withColumn("_ok", ok).select(*[F.when(F.col("_ok"), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in old.columns])


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def reconcile(catalogue: DataFrame, listing: DataFrame, path: str, target: Column) -> DataFrame:
    """Status of each catalogue row against a listing of existing paths."""
    want = catalogue.withColumn("target", target)
    here = listing.select(F.col("path").alias(path), F.lit(True).alias("_here"))
    there = listing.select(F.col("path").alias("target"), F.lit(True).alias("_there"))
    return (
        want.join(here, path, "left").join(there, "target", "left")
        .withColumn(
            "status",
            F.when(F.col("_here").isNull(), "missing")
            .when(F.col(path) == F.col("target"), "already_organized")
            .when(F.col("_there"), "target_exists")
            .otherwise("to_move"),
        )
        .drop("_here", "_there")
    )


def template_matches(classes: DataFrame, templates: Column, n: str = "n") -> DataFrame:
    """Rows per stored filter template, from class counts of the catalogue.

    `templates` is a fixed array of structs (name, matches) evaluated per class.
    """
    hits = classes.select(F.col(n), F.inline(templates).alias("template", "hit"))
    return hits.groupBy("template").agg(F.sum(F.when(F.col("hit"), F.col(n)).otherwise(0)).alias("available")).withColumn(
        "validated", F.col("available") > 0
    )
