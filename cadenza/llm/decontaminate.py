"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes may differ by e = floor(n * rate) edits. Cut into e + 1 pieces, at least one piece of it survives
unchanged in any such copy. Pieces are found exactly in one pass over the texts (a bit table over the first eight bytes,
then the whole piece); around each hit, Myers' bit-parallel algorithm gives the smallest edit distance of the item to any
stretch of the text.

Items and texts are compared lower-cased (A-Z) with white space made single, in bytes. The items are the stated query set: they are read
in blocks of bounded bytes and each block is broadcast and held against all texts. The texts do not shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.shared import ROW, numbered

RATE = 0.05
#: Shortest piece; where a budget would need shorter ones, the budget is cut to what such pieces allow.
PIECE = 8
#: Bytes of items in one broadcast block.
ITEM_BYTES = 16 << 20
_TABLE_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain(column: str):
    """Lower-cased A-Z, white space single, none at the ends."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.trim(F.translate(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), "".join(chr(65 + k) for k in range(26)), "".join(chr(97 + k) for k in range(26))))


def budget(n: int, rate: float) -> int:
    """Edits allowed to an item of n bytes."""
    return max(0, min(int(n * rate), n // PIECE - 1))


def cuts(n: int, edits: int) -> list[tuple[int, int]]:
    """edits + 1 pieces of near equal length that cover n bytes."""
    at = [n * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(at[:-1], at[1:]))


class Matcher:
    """All pieces of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float) -> None:
        self.items = [(i, x, budget(len(x), rate)) for i, x in items if x]
        keys, self.pieces = [], []
        self.tiny = [k for k, (_, x, _) in enumerate(self.items) if len(x) < PIECE]
        for k, (_, x, e) in enumerate(self.items):
            if len(x) >= PIECE:
                for a, b in cuts(len(x), e):
                    keys.append(int.from_bytes(x[a: a + PIECE], "little"))
                    self.pieces.append((k, a, x[a:b]))
        keys = np.array(keys, dtype=np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[((self.keys * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.masks: dict[int, dict[int, int]] = {}

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, offset of the piece in the item) of every exact piece in the bytes."""
        n = len(data) - PIECE + 1
        found = []
        for shift in range(min(PIECE, max(0, n))):
            count = (len(data) - shift) // PIECE
            codes = data[shift: shift + count * PIECE].view(np.uint64) if shift == 0 else np.frombuffer(data[shift: shift + count * PIECE].tobytes(), dtype=np.uint64)
            at = np.flatnonzero(self.table[((codes * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys, codes[at]), np.searchsorted(self.keys, codes[at], side="right")
            real = hi > lo
            found += zip((at[real] * PIECE + shift).tolist(), lo[real].tolist(), hi[real].tolist())
        raw = data.tobytes() if found or self.tiny else b""
        for place, lo, hi in found:
            for k in self.order[lo:hi].tolist():
                item, offset, piece = self.pieces[k]
                if raw[place: place + len(piece)] == piece:
                    yield place, item, offset
        for k in self.tiny:
            at = raw.find(self.items[k][1])
            while at >= 0:
                yield at, k, 0
                at = raw.find(self.items[k][1], at + 1)

    def distance(self, item: int, window: bytes) -> tuple[int, int]:
        """Smallest edit distance of the item to a stretch of the window, and the leftmost end of such a stretch."""
        _, pattern, edits = self.items[item]
        if edits == 0:
            at = window.find(pattern)
            return (0, at + len(pattern)) if at >= 0 else (1, 0)
        masks = self.masks.get(item)
        if masks is None:
            masks = {}
            for k, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << k
            self.masks[item] = masks
        m = len(pattern)
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for k, c in enumerate(window):
            eq = masks.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            if score < best:
                best, end = score, k + 1
        return best, end

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) for each text and item that match, the best place only."""
        raw = data.tobytes()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for place, item, offset in self.hits(data):
            _, pattern, edits = self.items[item]
            text = int(np.searchsorted(offsets, place, side="right")) - 1
            start = place - offset
            if (text, item, start) in tried or best.get((text, item), (1,))[0] == 0:
                continue
            tried.add((text, item, start))
            lo = max(int(offsets[text]), start - edits)
            hi = min(int(offsets[text + 1]) - 1, start + len(pattern) + edits)
            distance, end = self.distance(item, raw[lo:hi])
            if distance <= edits and (distance, lo + end) < best.get((text, item), (edits + 1, 0)):
                best[text, item] = (distance, lo + end)
        for (text, item), (distance, end) in best.items():
            yield text, item, distance, end - int(offsets[text])


def _scan(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher.value
        for batch in batches:
            for i, _, data, offsets in B.slices(batch["t"]):
                rows = list(own.search(data, offsets))
                if rows:
                    text, item, distance, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        batch["doc_id"].take(pa.array(np.array(text) + i)), pa.array([own.items[k][0] for k in item], pa.int64()),
                        pa.array(distance, pa.int32()), pa.array([own.items[k][2] for k in item], pa.int32()), pa.array(end, pa.int64()),
                    ], names=["doc_id", "item_id", "distance", "budget", "end_byte"])
    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded bytes; only one block is on the driver at a time."""
    block, held = [], 0
    for i, x in items.toLocalIterator():
        block.append((i, x.encode()))
        held += len(x)
        if held > ITEM_BYTES:
            yield block
            block, held = [], 0
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, end_byte): every pair of a text and an item within the item's budget.

    The best place counts (smallest distance, then leftmost end, in bytes of the normalised text). Null and empty texts
    and items match nothing. Items under 16 bytes must occur exactly. Repeated rows give repeated pairs; items of one
    text each give their own; ids may be null. Empty tables give an empty result. Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(plain("text"), F.lit("\n")).alias("t"))
    out = None
    for block in _blocks(benchmark.select(F.col("item_id").cast("long"), plain("text"))):
        matcher = spark.sparkContext.broadcast(Matcher(block, rate))
        found = texts.mapInArrow(_scan(matcher), "doc_id long, item_id long, distance int, budget int, end_byte long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `docs` that match no item, each by its own text, whatever its id; columns as before."""
    rows = numbered(docs)
    hit = contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(hit, ROW, "left_anti").select(*docs.columns)
