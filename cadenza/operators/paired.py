"""Cosines of given pairs of rows: the vectors go to blocks and the pairs to the cells of two blocks.

A pair row stays narrow: vectors are copied to cells, not to pairs, and a cell holds a bounded number of both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from .nearest import _matrix

#: Vectors of a block, pairs of a cell, and pairs of one tile.
BLOCK, CELL, TILE = 8192, 1 << 19, 8192


def with_cosines(
    pairs: DataFrame, n_pairs: int, vecs: DataFrame, n_vecs: int, left: str, right: str, spans: dict[str, tuple[int, int]],
    block: int = BLOCK, cell_pairs: int = CELL,
) -> DataFrame:
    """`pairs` with a cosine for each span (name: first entry, entries) of the vectors that `left` and `right` name by `vec_id`.

    A cosine is null where a part has no length. Pairs of unknown ids are left out, as in a join.
    """
    blocks = max(1, math.ceil(n_vecs / block))
    cells = max(math.ceil(n_pairs / cell_pairs), min(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_pairs / 4096)))
    salts = max(1, math.ceil(cells / blocks**2))
    width = max(a + n for a, n in spans.values())
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    salt = F.pmod(F.xxhash64(*pairs.columns), F.lit(salts)).cast("int")
    a = pairs.withColumns({"_lb": of(left), "_rb": of(right), "_salt": salt})
    full = vectors.pad_to(F.coalesce("vec", F.array().cast("array<double>")), width)
    rows = vecs.select("vec_id", full.alias("vec")).withColumn("_own", of("vec_id")).withColumn("_other", every(blocks)).withColumn("_salt", every(salts))
    b = rows.select("vec_id", "vec", "_salt", F.inline(F.array(
        F.struct(F.lit(True).alias("_left"), F.col("_own").alias("_lb"), F.col("_other").alias("_rb")),
        F.struct(F.lit(False).alias("_left"), F.col("_other").alias("_lb"), F.col("_own").alias("_rb")))))
    keep = pairs.columns

    def found(ids: np.ndarray, of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(ids, kind="stable")
        at = by[np.minimum(np.searchsorted(ids[by], of_rows), len(ids) - 1)]
        return at, ids[at] == of_rows

    def cell(pt: pa.Table, vt: pa.Table) -> pa.Table:
        is_left = vt.column("_left").to_numpy(zero_copy_only=False).astype(bool) if vt.num_rows else np.zeros(0, dtype=bool)
        sides = [vt.filter(pa.array(m)) for m in (is_left, ~is_left)]
        known = np.zeros(0, dtype=np.int64)
        if pt.num_rows and all(t.num_rows for t in sides):
            ids = [t.column("vec_id").to_numpy() for t in sides]
            lm, rm = (_matrix(t.column("vec"), t.num_rows) for t in sides)
            named = pt.filter(pc.and_(pt.column(left).is_valid(), pt.column(right).is_valid()))
            (li, l_ok), (ri, r_ok) = (found(i, named.column(c).to_numpy()) for i, c in zip(ids, (left, right)))
            known = np.flatnonzero(l_ok & r_ok)
            li, ri, pt = li[known], ri[known], named.take(pa.array(known))
        else:
            pt = pt.slice(0, 0)
        out = pt.select(keep)
        for name, (first, n) in spans.items():
            cos = np.full(len(known), np.nan)
            if len(known):
                x, y = lm[:, first: first + n], rm[:, first: first + n]
                nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                for at in range(0, len(known), TILE):
                    i, j = li[at: at + TILE], ri[at: at + TILE]
                    size = nx[i] * ny[j]
                    np.divide(np.einsum("ij,ij->i", x[i], y[j]), size, out=cos[at: at + TILE], where=size > 0)
            out = out.append_column(name, pa.array(cos, mask=np.isnan(cos)))
        return out

    schema = T.StructType([*pairs.schema.fields, *[T.StructField(s, T.DoubleType()) for s in spans]])
    on = ["_lb", "_rb", "_salt"]
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(cell, schema)
