"""Ranked lexical search over a document FP-tree.

For each item, the documents with the highest score; the score sums, over the item's distinct terms,
w * ((1000000000 * tf) div (1000 * tf + 20 * m)), with a term weight w that falls with its document frequency and a
document's m that grows with its length. All of it is 64-bit integer but for the logarithm in w.

Method. A document is restricted to the terms of the items and written as a vector of term ranks, most frequent term first.
Sorted vectors share the paths of a trie. A node stands for the documents below it and knows, for each term that occurs
there, the largest tf, and the least m and the least id. These bound the score of every document below: the score grows
with tf and falls with m. An item is searched depth first, the child of the highest bound first, and a branch is cut where
its bound, ties included, can't enter the item's best documents any more. Paths without a fork are one edge; a node that
keeps over half of its parent's documents is opened in place; up to LEAF documents of neighbouring branches are a leaf.

Plan. Items come in blocks of bounded bytes, the only thing that is broadcast. For a block the texts are read once and give
the restricted vectors, which are written; two sums over them give the counts of terms and lengths. Each task builds a tree
for every TREE_ROWS documents it reads and carries the items' best lists from tree to tree, so it gives at most `best` rows
an item, of which the best are ranked at the end. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.shared import staged

BEST = 50
#: Bytes of item texts in one block.
ITEM_BYTES = 1 << 20
#: Documents and vector entries of one tree; a document with more entries has a tree of its own.
TREE_ROWS, TREE_ENTRIES = 8192, 1 << 21
LEAF = 16
#: Ranks of a vector that are compared when paths are split.
PATH = 64
LAST_ID = np.iinfo(np.int64).max

#: Bytes that separate terms: ASCII but letters and digits.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def term_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every term of a slice of texts, A-Z lower-cased."""
    apart = _APART[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if len(data) and not apart[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], B.word_hashes(data, edge[0::2], edge[1::2])


class Items:
    """A block of items: sorted term hashes, and the terms of each item as places in them."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        texts = [f"{t}\n".encode() for _, t in rows]
        bounds = np.cumsum([0, *map(len, texts)])
        starts, hashes = term_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
        at = np.searchsorted(starts, bounds)
        self.ids = [i for i, _ in rows]
        self.terms, place = np.unique(hashes, return_inverse=True)
        self.of = [np.unique(place[i:j]) for i, j in zip(at, at[1:])]


def _vectors(shared):
    """Per document with a term: id, number of terms, and its terms of the items with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        wide = max(1, len(terms))
        for batch in batches:
            for i, j, data, offsets in B.slices(batch["t"]):
                starts, hashes = term_hashes(data)
                at = np.searchsorted(starts, offsets)
                text = np.repeat(np.arange(j - i), np.diff(at))
                place = np.searchsorted(terms, hashes)
                known = place < len(terms)
                known[known] = terms[place[known]] == hashes[known]
                keys, times = np.unique(text[known] * wide + place[known], return_counts=True)
                ends = np.searchsorted(keys, np.arange(j - i + 1) * wide)
                rank, times = (keys % wide).astype(np.int32), times.astype(np.int32)
                full = np.flatnonzero(np.diff(at))
                part = lambda x: pa.array([x[ends[d]: ends[d + 1]].tobytes() for d in full], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array(full + i)), pa.array(np.diff(at)[full]), part(rank), part(times),
                ], names=["doc_id", "n", "terms", "counts"])
    return run


def _document_counts(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide, dtype=np.int64)
        for batch in batches:
            for x in batch["terms"]:
                total[np.frombuffer(x.as_buffer(), dtype=np.int32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "documents"])
    return run


def score(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Summed over the terms: rows have their weight, columns their m."""
    return (weight[:, None] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))).sum(axis=0)


class Lists:
    """For each rank, the rows that have it and their tf."""

    def __init__(self, keys: np.ndarray, tfs: np.ndarray, wide: int) -> None:
        rank = keys % wide
        by = np.argsort(rank, kind="stable")
        self.rows, self.tfs = (keys // wide)[by], tfs[by]
        self.starts = np.searchsorted(rank[by], np.arange(wide + 1))

    def table(self, ranks: np.ndarray, rows: int) -> np.ndarray:
        """tf of each of `ranks` in every row."""
        out = np.zeros((len(ranks), rows), dtype=np.int64)
        for k, r in enumerate(ranks):
            part = slice(self.starts[r], self.starts[r + 1])
            out[k, self.rows[part]] = self.tfs[part]
        return out


class Tree:
    """The trie of some documents: `lo`, `hi` and `kids` of each node, its tf maxima by rank, its least m and id."""

    def __init__(self, ids: np.ndarray, some: np.ndarray, m: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, wide: int) -> None:
        self.wide, n = wide, len(ids)
        sizes = np.diff(bounds)
        paths = np.zeros((n, PATH), dtype=np.uint32)  # rank + 1, 0 where the vector has ended
        row, column = np.repeat(np.arange(n), sizes), np.arange(len(ranks)) - np.repeat(bounds[:-1], sizes)
        head = column < PATH
        paths[row[head], column[head]] = ranks[head] + 1
        raw = paths.astype(">u4").tobytes()
        order = np.array(sorted(range(n), key=lambda d: raw[4 * PATH * d: 4 * PATH * (d + 1)]))
        self.ids, self.some, self.m, self.paths = ids[order], some[order], m[order], paths[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.arange(n)
        keys = new[row] * wide + ranks
        self.docs = Lists(keys, tfs, wide)
        self._fork(n)
        self._bound(keys, tfs)
        del self.paths

    def _forks(self, lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of the children of a range, forks that keep over `most` documents opened in place."""
        differ = np.flatnonzero(self.paths[lo] != self.paths[hi - 1])
        if not len(differ):  # one path: pieces of it
            step = max(LEAF, (hi - lo) // 8)
            yield from ((a, min(a + step, hi)) for a in range(lo, hi, step))
            return
        column = self.paths[lo:hi, differ[0]]
        edge = [lo, *(np.flatnonzero(column[1:] != column[:-1]) + lo + 1).tolist(), hi]
        for a, b in zip(edge, edge[1:]):
            if b - a > most:
                yield from self._forks(a, b, most)
            else:
                yield a, b

    def _fork(self, n: int) -> None:
        self.lo, self.hi, self.parent, self.depth, self.kids = [0], [n], [-1], [0], [None]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            first, joined = len(self.lo), []
            for a, b in self._forks(lo, hi, (hi - lo) // 2):
                if joined and b - joined[-1][0] <= LEAF:
                    joined[-1] = (joined[-1][0], b)
                else:
                    joined.append((a, b))
            for a, b in joined:
                self.lo.append(a)
                self.hi.append(b)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.kids.append(None)
            self.kids[node] = np.arange(first, len(self.lo))
            todo.extend(range(first, len(self.lo)))

    def _bound(self, doc_keys: np.ndarray, tfs: np.ndarray) -> None:
        self.lo, self.hi, parent, depth = (np.array(x) for x in (self.lo, self.hi, self.parent, self.depth))
        self.leaf = np.array([k is None for k in self.kids])
        leaves = np.flatnonzero(self.leaf)
        leaves = leaves[np.argsort(self.lo[leaves])]
        owner = np.repeat(leaves, (self.hi - self.lo)[leaves])
        held, tops = self._maxima(owner[doc_keys // self.wide] * self.wide + doc_keys % self.wide, tfs)
        all_keys, all_tops, level = [held], [tops], depth.max(initial=0)
        while level:  # children of one level give the maxima of their parents
            at = depth[held // self.wide] == level
            up, most = self._maxima(parent[held[at] // self.wide] * self.wide + held[at] % self.wide, tops[at])
            all_keys.append(up)
            all_tops.append(most)
            held, tops = np.concatenate((held[~at], up)), np.concatenate((tops[~at], most))
            level -= 1
        self.tops = Lists(np.concatenate(all_keys), np.concatenate(all_tops), self.wide)
        least = lambda x: np.array([x[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.least_m, self.least_id = least(self.m), least(self.ids)

    @staticmethod
    def _maxima(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(keys)
        keys, values = keys[by], values[by]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.maximum.reduceat(values, first) if len(first) else values

    def search(self, ranks: np.ndarray, weight: np.ndarray, found: "Best") -> None:
        """Adds to `found` what belongs there, depth first; a branch that can't enter is not gone into."""
        tops = score(self.tops.table(ranks, len(self.lo)), self.least_m, weight)
        tfs = None
        stack = [0]
        while stack:
            node = stack.pop()
            if not found.may_enter(tops[node: node + 1], self.least_id[node: node + 1])[0]:
                continue
            kids = self.kids[node] if self.kids[node] is not None else np.array([node])
            kids = kids[found.may_enter(tops[kids], self.least_id[kids])]
            kids = kids[np.argsort(tops[kids])]
            leaf = self.leaf[kids]
            stack.extend(kids[~leaf].tolist())
            kids = kids[leaf][::-1]
            step = 4
            while len(kids):  # leaves of the highest bounds first, more of them at a time
                if tfs is None:
                    tfs = self.docs.table(ranks, len(self.ids))
                docs = np.concatenate([np.arange(self.lo[k], self.hi[k]) for k in kids[:step]])
                found.add(score(tfs[:, docs], self.m[docs], weight), self.ids[docs], self.some[docs])
                kids = kids[step:]
                kids = kids[found.may_enter(tops[kids], self.least_id[kids])]
                step *= 2


class Best:
    """The best documents of an item so far: highest score, then smallest id."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.scores, self.ids, self.some = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def may_enter(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(self.scores) < self.size:
            return scores > 0
        return (scores > self.scores[-1]) | ((scores == self.scores[-1]) & (ids < self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray, some: np.ndarray) -> None:
        new = self.may_enter(scores, ids)
        if new.any():
            scores, ids, some = (np.concatenate((a, b[new])) for a, b in ((self.scores, scores), (self.ids, ids), (self.some, some)))
            by = np.lexsort((ids, -scores))[: self.size]
            self.scores, self.ids, self.some = scores[by], ids[by], some[by]


def _search(shared, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rank_of, weights, wide = own["rank_of"], own["weights"], max(1, len(own["rank_of"]))
        found = [Best(best) for _ in own["of"]]
        held: list[pa.RecordBatch] = []

        def tree():
            part = pa.Table.from_batches(held).combine_chunks()
            flat = lambda k: np.frombuffer(b"".join(part[k].to_pylist()), dtype=np.int32)
            sizes = pc.binary_length(part["terms"]).to_numpy() // 4
            row = np.repeat(np.arange(len(part)), sizes)
            rank = rank_of[flat("terms")]
            by = np.argsort(row * wide + rank)
            some = part["doc_id"].is_valid().to_numpy()
            ids = part["doc_id"].fill_null(LAST_ID).to_numpy()
            m = 50 + 50 * part["n"].to_numpy() * own["documents"] // own["terms"]
            t = Tree(ids, some, m, np.concatenate(([0], np.cumsum(sizes))), rank[by], flat("counts")[by].astype(np.int64), wide)
            for k, ranks in enumerate(own["of"]):
                t.search(ranks, weights[ranks], found[k])
            held.clear()

        rows = entries = 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch["terms"]).to_numpy(zero_copy_only=False) // 4)
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                fit = int(np.searchsorted(ends, before + TREE_ENTRIES - entries, side="right"))
                to = min(len(batch), at + TREE_ROWS - rows, max(fit, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    rows, entries = rows + to - at, entries + int(ends[to - 1]) - before
                    at = to
                if at < len(batch):
                    tree()
                    rows = entries = 0
        if held:
            tree()
        for k, f in enumerate(found):
            if len(f.scores):
                n = len(f.scores)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, k, dtype=np.int32)), pa.array([own["ids"][k]] * n, pa.int64()),
                    pa.array(f.ids, mask=~f.some), pa.array(f.scores)], names=["item", "item_id", "doc_id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded bytes; only one block is on the driver at a time."""
    block, held = [], 0
    for i, x in items.toLocalIterator():
        block.append((i, x))
        held += len(x.encode())
        if held > ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `items` its `best` rows of `docs` with the highest score above 0.

    Equal scores go by ascending id, a null id last. Rows of one id count by themselves, among documents and items alike;
    repeated items each get their own ranks. Null and empty texts, and texts without a term, match nothing and count for
    no statistic. Texts of any length are read whole. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), B.closed_text(text).alias("t"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for rows in _blocks(items.select(F.col(item_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))):
        block = Items(rows)
        shared = spark.sparkContext.broadcast(block.terms)
        vectors = staged(texts.mapInArrow(_vectors(shared), "doc_id long, n long, terms binary, counts binary"), "vectors")
        documents, terms = vectors.agg(F.count("*"), F.sum("n")).first()
        counted = vectors.mapInArrow(_document_counts(len(block.terms)), "term int, documents long").groupBy("term").agg(F.sum("documents"))
        df = np.zeros(len(block.terms), dtype=np.int64)
        for term, n in counted.collect():  # at most one row for each term of the block
            df[term] = n
        order = np.argsort(-df, kind="stable")
        rank_of = np.empty(len(order), dtype=np.int64)
        rank_of[order] = np.arange(len(order))
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df[order] + 1))).astype(np.int64)
        search = spark.sparkContext.broadcast({
            "rank_of": rank_of, "weights": weights, "of": [rank_of[x] for x in block.of], "ids": block.ids, "documents": documents, "terms": terms or 1})
        found = vectors.mapInArrow(_search(search, best), "item int, item_id long, doc_id long, score long")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        out = out.unionByName(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score"))
    return out
