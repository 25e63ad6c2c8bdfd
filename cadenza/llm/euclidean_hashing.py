"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors of one label and one length link at a cosine of 0.93 or more, in double precision. A normalised pair at that cosine
is `DISTANCE` apart. A table hashes a vector by `folds` numbers floor((a . v + b) / WIDTH), a with normal components
(2-stable), b uniform: one number agrees with a chance that falls with the distance of the pair, `agreement`. A bucket holds
the vectors of one label whose numbers all agree. There are as many folds as bring the buckets of the largest label down to
about BUCKET unrelated vectors, and as many tables as give a pair right at the threshold a chance of RECALL to share a
bucket; closer pairs have a better one.

Plan. Equal vectors are one node. Keys (eight bytes a table) shuffle first; only nodes that share a bucket then ship their
vector. A bucket is worked on in cells of two blocks of at most BLOCK nodes, so that a bucket of any size is split. A cell
checks its pairs by exact cosine and gives no pairs: it gives the number of links of each node, counted only in the first
table in which the pair shares a bucket, and a spanning forest of its links, from which the components follow. No bucket is
cut; cells of a bucket of near copies take a time that grows with its square, for each of its links is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bytesets import mix
from cadenza.llm.shared import components, staged

COSINE = 0.93
WIDTH = 2.0
#: Distance taken for unrelated vectors when the number of folds is chosen; it bears on the cost, not on the links.
APART = 1.2
BUCKET, LEAST_FOLDS = 64, 8
RECALL = 0.98
#: Nodes of one block of a bucket.
BLOCK = 1024
SEED = 20240401

_U = np.uint64


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash number of two vectors agrees."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(folds, tables) for labels of up to `rows` vectors."""
    folds = max(LEAST_FOLDS, math.ceil(math.log(max(rows, 1) / BUCKET) / -math.log(agreement(APART))))
    meets = agreement(math.sqrt(2 - 2 * cosine)) ** folds
    return folds, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def normalised(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hashes:
    """The projections of every table, for each vector length that is met."""

    def __init__(self, folds: int, tables: int) -> None:
        self.folds, self.tables = folds, tables
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(vectors, tables) 64-bit keys of label, table and numbers."""
        n, size = x.shape
        if size not in self.planes:
            rng = np.random.default_rng([SEED, size])
            k = self.folds * self.tables
            self.planes[size] = rng.standard_normal((size, k)), rng.uniform(0, WIDTH, k)
        a, b = self.planes[size]
        numbers = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(_U).reshape(n, self.tables, self.folds)
        key = mix(label.astype(np.int64).view(_U), size)[:, None] + mix(np.arange(self.tables, dtype=np.int64).view(_U), 3)[None, :]
        for f in range(self.folds):
            key = mix(key ^ numbers[:, :, f], 0x9E37 + f)
        return key.view(np.int64)


def _keyed(folds: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(folds, tables)
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                keys = hashes.keys(normalised(own["vector"], int(size)), own["label"].to_numpy())
                yield pa.RecordBatch.from_arrays([
                    own["node"], own["times"], own["vector"], own["size"], pa.array([k.tobytes() for k in keys], pa.binary()),
                ], names=["node", "times", "vector", "size", "keys"])
    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = np.frombuffer(b"".join(batch["keys"].to_pylist()), dtype=np.int64).reshape(len(batch), -1)
            tables = keys.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(batch))),
                pa.array(np.repeat(batch["node"].to_numpy(), tables)),
            ], names=["key", "table", "node"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) form a spanning forest, by merging smaller labels outwards until nothing changes."""
    root = np.arange(n)
    keep = np.zeros(len(a), dtype=bool)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = root[a[open_]], root[b[open_]]
        open_, x, y = open_[x != y], x[x != y], y[x != y]
        if not len(open_):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        into, first = np.unique(high, return_index=True)  # one link for each root that is the higher of its two
        root[into] = low[first]
        keep[open_[first]] = True
        while (root != root[root]).any():
            root = root[root]
    return keep


def _cells(cosine: float):
    def of_cell(table, node, times, block, keys, x):
        n = len(node)
        count, ends = np.zeros(n, dtype=np.int64), []
        for lo in range(0, n, 256):
            near = x[lo: lo + 256] @ x.T >= cosine
            a, b = np.nonzero(near)
            a += lo
            own = (a < b) & ((block[a] != block[b]) | (block[0] == block[-1]))
            a, b = a[own], b[own]
            for k in range(0, len(a), 1 << 16):
                i, j = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
                np.add.at(count, i, times[j])
                np.add.at(count, j, times[i])
                kept = _forest(n, i, j)
                ends.append(np.stack((i[kept], j[kept])))
        i, j = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), dtype=np.int64)
        kept = _forest(n, i, j)
        met = np.flatnonzero(count)
        u, v = np.concatenate((node[met], node[i[kept]])), np.concatenate((node[met], node[j[kept]]))
        links = np.concatenate((count[met], np.zeros(kept.sum(), dtype=np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links)], names=["u", "v", "links"])

    def finished(part: pa.RecordBatch):
        if len(part) < 2:
            return
        names = ("key", "bi", "bj", "size")
        cols = [part[k].to_numpy() for k in names]
        edge = np.zeros(len(part), dtype=bool)
        edge[0] = True
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(edge)
        for lo, hi in zip(start, [*start[1:], len(part)]):
            if hi - lo < 2:
                continue
            own = part.slice(lo, hi - lo)
            x = normalised(own["vector"], int(cols[3][lo]))
            keys = np.frombuffer(b"".join(own["keys"].to_pylist()), dtype=np.int64).reshape(len(own), -1)
            found = of_cell(int(own["table"][0].as_py()), own["node"].to_numpy(), own["times"].to_numpy(), own["block"].to_numpy(), keys, x)
            if len(found):
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket and cell; at most one unfinished cell is carried from batch to batch."""
        carry = None
        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([carry, batch] if carry is not None else [batch]).combine_chunks().to_batches()[0]
            last = np.ones(len(part), dtype=bool)
            for k in ("key", "bi", "bj", "size"):
                c = part[k].to_numpy()
                last &= c == c[-1]
            end = int(np.argmax(last))
            yield from finished(part.slice(0, end))
            carry = part.slice(end)
        if carry is not None:
            yield from finished(carry)
    return run


def near_groups(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    n_links counts the other rows linked directly, equal vectors of the label too. A null label, a null, empty or zero
    vector, and one with null or non-finite components link with nothing: 0 links, a component of their own. Vectors of
    different lengths are never compared. Rows of one id count by themselves. A row with a null id takes part and is
    returned with the smallest id of its component, null if there is none; it is kept only in the latter case. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).cast("long").alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    digest = lambda seed: F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", F.size("vector"), "vector", F.lit(seed)))
    rows = staged(rows.withColumns({"low_digest": digest(1), "high_digest": digest(2)}), "vectors")
    digests = ["low_digest", "high_digest"]
    nodes = rows.where("low_digest is not null").groupBy(*digests).agg(
        F.min("vec_id").alias("low"), F.count("*").alias("times"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    nodes = staged(nodes.withColumns({"node": F.monotonically_increasing_id(), "size": F.size("vector")}), "nodes")
    folds, tables = shape(nodes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0, cosine, recall)
    kind = dict(nodes.dtypes)["vector"]
    keyed = staged(nodes.mapInArrow(_keyed(folds, tables), f"node long, times long, vector {kind}, size int, keys binary"), "keyed")

    entries = keyed.select("node", "keys").mapInArrow(_entries, "key long, table int, node long")
    blocks = F.ceil(F.col("nodes") / block).cast("int")
    shared = entries.groupBy("key", "table").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key", "table", blocks.alias("blocks"))
    met = entries.join(shared, ["key", "table"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = (
        met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "key", "table", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        .join(keyed, "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "size", "block")
        .select("key", "table", "bi", "bj", "block", "node", "times", "vector", "size", "keys")
    )
    found = staged(cells.mapInArrow(_cells(cosine), "u long, v long, links long"), "found")
    root = components(found.where("u <> v").select("u", "v")).withColumnRenamed("component", "root")
    links = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    groups = nodes.select("node", "low", "times", *digests).join(root, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = groups.groupBy("root").agg(F.min("low").alias("component_id"), F.lit(True).alias("known"))
    groups = groups.join(least, "root").select(*digests, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id", "known")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", *digests).join(groups, digests, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
