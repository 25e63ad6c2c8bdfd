"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct five-word shingles; two documents link at a Jaccard similarity of 0.75 or more.

Method. Shingles are ordered by frequency class, the rarest first. A set of size s that links with another keeps all but
floor(s / 4) of its shingles in common with it. Frequent shingles are dealt to classes by hash; a class is indexed by
pairs of its shingles, so n shingles of it stand for n - 1 errors, while each rare shingle, indexed alone, stands for
one. A prefix is extended until it stands for floor(s / 4) + 1 errors: two linked sets then share a rare shingle or a
pair. The number of classes follows the size band of the set; sets near the upper end of a band are indexed in the next
one as well, so that linked sets always meet.

Plan. Four passes over the texts, none of which shuffles a text that has no candidate:
1. set sizes, fingerprints, bit maps, and a frequency sketch of fixed size (summed block by block, 4 MB when broadcast);
2. index entries, shuffled by key; short lists give all pairs of similar size, long lists only pairs with their first set,
   the one with the smallest share of rare shingles: an original has fewer of them than the edited copies around it;
3. pairs that pass the bit maps (an upper bound of the overlap, so nothing is lost) are verified on the whole texts;
4. the verified links give components; long lists then give the pairs that lie in different components, in bounded cells,
   and these are verified too. Every pair that could join two components is thus tested, and no group gives all its pairs.

Equal sets are one node of the graph. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.cells import cut, merged
from cadenza.llm.lists import LIST_BLOCK, MAP_BITS, SIG_BITS, distinct_pairs, enough, folded, is_needed, later_pairs, needed_bits
from cadenza.llm.shared import ROW, components, numbered, released, staged

CELLS = 1 << 22
#: A shingle in at least so many sets counts as frequent, above what a cell of the sketch holds anyway.
FREQUENT = 16
#: Levels of rare shingles: a prefix takes the rarest ones first.
LEVELS = 64
#: Bit map of a set: at least four bits for each shingle, from MAP_BITS to this bound.
MOST_MAP_BITS = 1 << 18

_U = np.uint64


class Sets:
    """Shingle sets of a stream of Arrow batches, slice by slice; with `fresh`, only sets not yet seen in this task."""

    def __init__(self, fresh: bool) -> None:
        self.seen: set[int] | None = set() if fresh else None

    def of(self, texts: pa.Array):
        for i, j, data, off in B.slices(texts):
            flat, bounds = B.shingle_sets(data, off)
            node, second = B.fingerprints(flat, bounds)
            yield i, j, flat, bounds, node, second

    def is_new(self, node: int) -> bool:
        if node in self.seen:
            return False
        self.seen.add(node)
        return True


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document id, size, fingerprint and bit map; per task the frequency sketch in blocks."""
    sets, sketch = Sets(fresh=True), np.zeros(CELLS, dtype=np.int32)
    for batch in batches:
        for i, j, flat, bounds, node, second in sets.of(batch["t"]):
            sizes = np.diff(bounds)
            maps, counted = [], np.zeros(len(flat), dtype=bool)
            place = B.mix(flat, 77)
            for d in range(len(sizes)):
                width = min(MOST_MAP_BITS, max(MAP_BITS, 1 << int(4 * sizes[d]).bit_length()))
                bits = np.zeros(width, dtype=bool)
                bits[(place[bounds[d]: bounds[d + 1]] & _U(width - 1)).astype(np.int64)] = True
                maps.append(np.packbits(bits).tobytes())
                if sizes[d] > 2 and sets.is_new(int(node[d])):
                    counted[bounds[d]: bounds[d + 1]] = True
            cells, times = np.unique(flat[counted] & _U(CELLS - 1), return_counts=True)
            sketch[cells.astype(np.int64)] += times.astype(np.int32)
            k = j - i
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(i, k).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(node), pa.array(second),
                pa.array(maps, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
            ], names=NAMES)
    for part in cut(sketch):
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, *part.columns], names=NAMES)


NAMES = ["doc_id", "n", "node", "second", "bits", "block", "places", "counts"]
PROFILE = "doc_id long, n long, node long, second long, bits binary, block int, places binary, counts binary"


def frequency_classes(profile: DataFrame, frequent: int) -> np.ndarray:
    """Class of each cell of the sketch, below LEVELS for rare: a table of fixed size, whatever the corpus.

    A cell also holds the shingles that fall there by chance, about `noise` with a deviation of its root.
    """
    counts = merged(profile.where("block is not null"), CELLS).astype(np.int64)
    noise = int(np.median(counts))
    low, high = int(np.quantile(counts, 0.01)), frequent + noise + 3 * int(np.sqrt(noise))
    level = np.clip(LEVELS * (counts - low) // (high - low), 0, LEVELS - 1)
    return np.where(counts < high, level, np.log2(np.maximum(counts - noise, 1)).astype(np.int64) + LEVELS).astype(np.uint8)


def signatures(tokens: np.ndarray, cls: np.ndarray, levels: int = 1) -> np.ndarray:
    """Index keys of one set: its rare prefix shingles, and pairs of its frequent prefix shingles by class and band.

    Classes below `levels` are rare, the lowest rarest.
    """
    n = len(tokens)
    order = np.argsort((cls.astype(_U) << _U(56)) | (tokens >> _U(8)))
    tokens, rare = tokens[order], cls[order] < levels
    errors = n // 4 + 1
    bands = [n.bit_length() - 1]
    if n >= 3 * (1 << bands[0]) // 2:
        bands.append(bands[0] + 1)
    out, singles = [], 0
    n_rare = int(rare.sum())
    if n_rare >= errors:
        return B.mix(tokens[:errors], 11)
    frequent = tokens[n_rare:]
    out.append(B.mix(tokens[:n_rare], 11))
    for band in bands:
        classes = max(1, (1 << band) // 3)
        own = (B.mix(frequent, 23) % _U(classes)).astype(np.int64)
        by = np.argsort(own, kind="stable")
        first = np.ones(len(by), dtype=bool)
        first[1:] = own[by][1:] != own[by][:-1]
        adds = np.ones(len(by), dtype=np.int64)
        adds[by[first]] = 0
        reach = np.cumsum(adds) >= errors - n_rare
        end = int(np.argmax(reach)) + 1 if reach.any() else len(frequent)
        by = by[by < end]
        group, members = own[by], B.mix(frequent[by], 31 + band)
        for step in range(1, end):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            out.append(B.mix((members[step:] + members[:-step])[same], 43))
    return np.unique(np.concatenate(out))


def _index(table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes = Sets(fresh=True), table.value
        for batch in batches:
            for _, _, flat, bounds, node, _ in sets.of(batch["t"]):
                cls = classes[(flat & _U(CELLS - 1)).astype(np.int64)]
                keys, nodes, sizes, own_rare = [], [], [], []
                for d in range(len(node)):
                    lo, hi = bounds[d], bounds[d + 1]
                    if hi - lo > 2 and sets.is_new(int(node[d])):
                        own = signatures(flat[lo:hi], cls[lo:hi], LEVELS) >> _U(64 - SIG_BITS)
                        keys.append(own.view(np.int64))
                        nodes.append(np.full(len(own), node[d]))
                        sizes.append(np.full(len(own), hi - lo, dtype=np.int32))
                        own_rare.append(np.full(len(own), 255 * int((cls[lo:hi] < LEVELS).sum()) // (hi - lo), dtype=np.int16))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (keys, nodes, sizes, own_rare)], names=["sig", "node", "n", "rare"])
    return run


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [folded(np.frombuffer(x.as_buffer(), dtype=np.uint64), MAP_BITS // 64).tobytes() for x in batch["bits"]]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(maps, pa.binary())], names=["node", "small"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose bit maps bound the overlap below what a link needs; no linked pair is dropped."""
    for batch in batches:
        n_u, n_v = batch["n_u"].to_numpy(), batch["n_v"].to_numpy()
        apart = np.zeros(len(batch), dtype=np.int64)
        for k, (a, b) in enumerate(zip(batch["bits_u"], batch["bits_v"])):
            a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
            width = min(len(a), len(b))
            apart[k] = np.bitwise_count(folded(a, width) ^ folded(b, width)).sum()
        keep = pa.array(enough(n_u, n_v, apart))
        yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], names=["u", "v"])


def _texts_of(needed) -> Callable:
    """(node, text) of the sets that may be needed, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bits = Sets(fresh=True), needed.value
        for batch in batches:
            for i, j, _, _, node, _ in sets.of(batch["t"]):
                keep = is_needed(bits, node)
                keep &= np.array([bool(k) and sets.is_new(int(x)) for x, k in zip(node, keep)], dtype=bool)
                at = pa.array(np.flatnonzero(keep) + i)
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), batch["t"].take(at)], names=["node", "t"])
    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact test of each pair on its whole texts."""
    for batch in batches:
        u, v, ta, tb = batch["u"], batch["v"], batch["t_u"], batch["t_v"]
        keep = np.zeros(len(u), dtype=bool)
        for r in range(len(u)):
            (a, _), (b, _) = (B.shingle_sets(data, off) for x in (ta, tb) for _, _, data, off in B.slices(x.slice(r, 1)))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[r] = 100 * both >= 75 * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([u.filter(pa.array(keep)), v.filter(pa.array(keep))], names=["u", "v"])


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, of distinct candidate pairs."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    near = staged(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(_may_link, "u long, v long"), "near")
    needed = near.sparkSession.sparkContext.broadcast(needed_bits(near.select(F.explode(F.array("u", "v")).alias("node"))))
    text = texts.mapInArrow(_texts_of(needed), "node long, t string").groupBy("node").agg(F.first("t").alias("t"))
    text = staged(text, "texts")
    as_ = lambda k: text.select(F.col("node").alias(k), F.col("t").alias(f"t_{k}"))
    links = staged(near.join(as_("u"), "u").join(as_("v"), "v").select("u", "v", "t_u", "t_v").mapInArrow(_verify, "u long, v long"), "links")
    released(near, text)
    return links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`: the smallest id that its links reach.

    Null and empty texts, and texts of white space, are empty sets: they link with nothing. Texts of any length are read
    whole. Rows with equal sets, repeated rows too, are in one component. A row with a null id is returned with the
    smallest id of its component, null if there is none. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), B.closed_text(text).alias("t"))
    profile = staged(texts.mapInArrow(_profile, PROFILE), "profile")
    rows = profile.where("block is null")
    table = spark.sparkContext.broadcast(frequency_classes(profile, frequent))
    index = texts.mapInArrow(_index(table), "sig long, node long, n int, rare short")
    found_lists = staged(distinct_pairs(index, "rare"), "lists")
    nodes = rows.where("n > 2").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    first = found_lists.where("u is not null").select("u", "v").distinct()
    links = _links(first, nodes, texts)
    found = components(links)

    maps = nodes.select("node", "bits").mapInArrow(_small, "node long, small binary")
    second = staged(later_pairs(found_lists.where("u is null").select("sig", "node", "n"), found, maps, first, LIST_BLOCK), "second")
    released(found_lists)
    links = links.unionByName(_links(second, nodes, texts))
    released(second)
    found = components(links).withColumnRenamed("component", "root")

    group = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = group.join(group.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return rows.join(ids.withColumn("known", F.lit(True)), (rows.node == ids.node) & (rows.n > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component: of the smallest id, or of none if no row has one. Columns as before.

    Rows count by themselves, so rows of one id and different texts are apart; texts without shingles all stay.
    """
    rows = numbered(docs)
    found = jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    first = rows.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*docs.columns)
