"""Candidate pairs from lists of equal keys, without giving all pairs of a long list.

A row is (sig, node, n): a key, a set, and the set's size. Short lists give all pairs of similar size. Long lists give the
pairs with their first set at once; when those have been verified and give components, the pairs of a long list that lie
in different components follow, in bounded cells. Two sets often share many long lists; their pair is given by the first of
them, as told by the smallest keys that each row carries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.cells import cut, has_bits, merged

#: Longest list whose pairs are all emitted at once; longer ones go by components.
SHORT_LIST = 3
#: Rows of one block of a long list.
LIST_BLOCK = 2048
SIG_BITS = 48
MAP_BITS = 1024
NEEDED_BITS = 1 << 24
#: Keys that a row of a cell carries: the smallest ones of its set among the lists of several components.
CARRIED = 8

_U = np.uint64

PAIRS = "u long, v long, sig long, node long, n int"


def _out(pair: np.ndarray | None = None, sig=(), node=(), n=()) -> pa.RecordBatch:
    pair = np.zeros((0, 2), dtype=np.int64) if pair is None else pair
    k, m = len(pair), len(sig)
    left = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)])
    right = lambda x, t: pa.concat_arrays([pa.nulls(k, t), pa.array(x, t)])
    return pa.RecordBatch.from_arrays([
        left(pair[:, 0], pa.int64()), left(pair[:, 1], pa.int64()), right(sig, pa.int64()), right(node, pa.int64()), right(n, pa.int32()),
    ], names=["u", "v", "sig", "node", "n"])


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bit map as one of `width` words: places are hashes modulo the width, so halves fall together."""
    return bits if len(bits) == width else np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def enough(n_u, n_v, apart):
    """Whether sets whose maps differ in `apart` bits can link: at least so many shingles are not shared."""
    overlap = (n_u + n_v - apart.astype(np.int64)) // 2
    return 100 * overlap >= 75 * (n_u + n_v - overlap)


class _Pairs:
    """Collects pairs of similar size and gives them distinct, about a million at a time."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, a, b, n_a, n_b) -> None:
        near = (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)) & (a != b)
        a, b = a[near], b[near]
        self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        self.count += len(a)

    def full(self, at_least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if self.count >= at_least:
            pair = np.unique(np.concatenate(self.held), axis=0)
            self.held, self.count = [], 0
            yield _out(pair)


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: all pairs of a short list; pairs with the first set, and the rows, of a long one.

    Only an unfinished short list is carried from batch to batch; an unfinished long one is streamed.
    """
    pairs = _Pairs()
    names = ("sig", "node", "n")
    carry = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)]
    open_sig, anchor, anchor_n = None, None, None

    def finished(sig, node, n):
        if not len(sig):
            return
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        length = np.diff(np.concatenate((start, [len(sig)])))
        run_length = np.repeat(length, length)
        short = (run_length > 1) & (run_length <= SHORT_LIST)
        s, d, m = sig[short], node[short], n[short]
        for step in range(1, SHORT_LIST):
            same = s[step:] == s[:-step]
            if not same.any():
                break
            pairs.add(d[:-step][same], d[step:][same], m[:-step][same], m[step:][same])
        long = run_length > SHORT_LIST
        if long.any():
            first = np.repeat(start, length)[long]
            pairs.add(node[first], node[long], n[first], n[long])
            yield _out(None, sig[long], node[long], n[long])
        yield from pairs.full()

    for batch in batches:
        rows = [np.concatenate((c, batch[k].to_numpy())) for c, k in zip(carry, names)]
        fresh = np.ones(len(rows[0]), dtype=bool)
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[fresh] for x in rows]
        if open_sig is not None:
            more = int(np.searchsorted(rows[0], open_sig, side="right"))
            if more:
                sig, node, n = (x[:more] for x in rows)
                pairs.add(np.full(more, anchor), node, np.full(more, anchor_n), n)
                yield _out(None, sig, node, n)
                rows = [x[more:] for x in rows]
            if len(rows[0]):
                open_sig = None
        if not len(rows[0]):
            carry = rows
            continue
        end = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from finished(*(x[:end] for x in rows))
        carry = [x[end:] for x in rows]
        if len(carry[0]) > SHORT_LIST:
            sig, node, n = carry
            open_sig, anchor, anchor_n = sig[0], node[0], n[0]
            pairs.add(np.full(len(sig), anchor), node, np.full(len(sig), anchor_n), n)
            yield _out(None, sig, node, n)
            carry = [x[:0] for x in carry]
    yield from finished(*carry)
    yield from pairs.full(1)


def earlier(sig: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets with the carried keys a and b, row by row, meet in a list before `sig`.

    Their first list in common has none before it, so each pair is given at least once.
    """
    met = np.zeros(len(a), dtype=bool)
    for k in range(a.shape[1]):
        met |= (a[:, k] < sig) & (a[:, k, None] == b).any(axis=1)
    return met


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell: pairs of a cell that lie in different components and, off the diagonal, in different blocks.

    A pair that an earlier list gives is left to that list.
    """
    pairs = _Pairs()
    names = ("sig", "bi", "bj", "node", "n", "component", "block")
    carry = None

    def run(sig, node, n, comp, block, maps, keys, apart):
        for lo in range(0, len(node), 512):
            part = slice(lo, lo + 512)
            ok = (comp[part, None] != comp[None, :]) & (node[part, None] < node[None, :])
            ok &= 4 * np.minimum(n[part, None], n[None, :]) >= 3 * np.maximum(n[part, None], n[None, :])
            if apart:
                ok &= block[part, None] != block[None, :]
            a, b = np.nonzero(ok)
            for k in range(0, len(a), 1 << 16):
                i, j = a[k: k + (1 << 16)] + lo, b[k: k + (1 << 16)]
                near = enough(n[i], n[j], np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1))
                i, j = i[near], j[near]
                fresh = ~earlier(sig, keys[i], keys[j])
                pairs.add(node[i[fresh]], node[j[fresh]], n[i[fresh]], n[j[fresh]])

    def finished(cols):
        sig, bi, bj, node, n, comp, block, maps, keys = cols
        if not len(sig):
            return
        start = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))))
        for lo, hi in zip(start, [*start[1:], len(sig)]):
            if hi - lo > 1 and comp[lo:hi].min() != comp[lo:hi].max():
                run(sig[lo], node[lo:hi], n[lo:hi], comp[lo:hi], block[lo:hi], maps[lo:hi], keys[lo:hi], bi[lo] != bj[lo])
                yield from pairs.full()

    for batch in batches:
        if not len(batch):
            continue
        maps = b"".join(x.as_py() for x in batch["small"])
        cols = [
            *(batch[k].to_numpy() for k in names), np.frombuffer(maps, dtype=np.uint64).reshape(len(batch), -1),
            batch["keys"].flatten().to_numpy().reshape(len(batch), -1),
        ]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        end = int(np.argmax(last))
        yield from finished([x[:end] for x in cols])
        carry = [x[end:] for x in cols]
    if carry is not None:
        yield from finished(carry)
    yield from pairs.full(1)


def distinct_pairs(index: DataFrame, *order: str) -> DataFrame:
    """PAIRS of an index (sig, node, n): pairs to verify first, and the rows of long lists.

    `order` names columns of a node that say which set of a list comes first; the node itself breaks ties.
    """
    return index.repartition("sig").sortWithinPartitions("sig", *order, "node").mapInArrow(lists, PAIRS)


def later_pairs(rows: DataFrame, found: DataFrame, maps: DataFrame, first: DataFrame, block_rows: int) -> DataFrame:
    """(u, v): pairs of long lists whose ends lie in different components, but for those of `first`.

    `found` has the components of the links among `first`; `maps` a bit map (node, small) of MAP_BITS bits for each node.
    """
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("sig").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    rows = rows.join(mixed.select("sig", blocks.alias("blocks")), "sig")
    # A key of all ones, which no list has (SIG_BITS), fills up.
    keys = F.slice(F.concat(F.array_sort(F.collect_set("sig")), F.array_repeat(F.lit((1 << 63) - 1), CARRIED)), 1, CARRIED)
    maps = maps.join(rows.groupBy("node").agg(keys.alias("keys")), "node")
    placed = (
        rows
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(maps, "node")
        .select("sig", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", "n", "component", "block", "small", "keys")
        .repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj", "node")
    )
    return placed.mapInArrow(cells, PAIRS).select("u", "v").distinct().join(first, ["u", "v"], "left_anti")


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(NEEDED_BITS, dtype=np.uint8)
    for batch in batches:
        bits[(B.mix(batch["node"].to_numpy().view(_U), 5) & _U(NEEDED_BITS - 1)).astype(np.int64)] = 1
    yield from cut(bits)


def needed_bits(nodes: DataFrame) -> np.ndarray:
    """Packed bits, of a fixed number, that hold every node of the table `nodes` (node)."""
    return np.packbits(merged(nodes.mapInArrow(_bits_of, "block int, places binary, counts binary"), NEEDED_BITS) > 0)


def is_needed(packed: np.ndarray, node: np.ndarray) -> np.ndarray:
    return has_bits(packed, (B.mix(node.view(_U), 5) & _U(NEEDED_BITS - 1)).astype(np.int64))
