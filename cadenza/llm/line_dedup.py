"""Fuzzy line dedup by MinHash.

A line is a stretch of a text between newlines, A-Z lower-cased, runs of white space as one space, trimmed. Its set holds
its distinct shingles of seven characters; a shorter line is one shingle. Two lines link at a Jaccard similarity of 0.75
or more; of each component of links, the first line stays.

Method. 64 minimum hashes of each distinct line give 16 bands of 4: a pair at 0.75 shares a band with probability 0.998, at
0.85 with 0.999996. Every pair that shares a band is verified exactly on both whole lines, and the links give components by
distributed union-find. A long band list first gives pairs with its first line, then, after these are verified, the pairs
between different components (`lists.py`), so that no list is cut and no group gives all its pairs.

Plan. The texts are read twice and never shuffled: once for the line table (position, hash, bands of distinct lines), once
for the lines that have a partner. Shingles are compared by 52-bit hashes, lines by 64-bit ones.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import bytesets as B
from cadenza.llm.lists import LIST_BLOCK, MAP_BITS, SIG_BITS, distinct_pairs, is_needed, later_pairs, needed_bits
from cadenza.llm.shared import components, staged

SHINGLE = 7
BANDS, BAND_ROWS = 16, 4
#: A chunk of lines that is worked on at once: its hashes fit into a processor cache.
CHUNK_LINES, CHUNK_SHINGLES = 4096, 1 << 16
#: Whole texts that are worked on at once, unless one is longer.
SLICE_BYTES = 1 << 18

_U = np.uint64
_TAG = 12
_RNG = np.random.default_rng(20240301)
_FLIP, _TIMES = (_RNG.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=_U) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, dtype=bool)
_SEP[list(B.SPACES)] = True


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per character (its UTF-8 bytes), and the offsets counted in characters."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[start].astype(np.uint32)
    width = np.diff(start, append=len(data))
    for k in (1, 2, 3):
        wide = np.flatnonzero(width > k)
        code[wide] |= data[start[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return code, np.searchsorted(start, offsets)


def normalised_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, bounds of the lines that are not blank, row of each, number of each in its text)."""
    code, at = characters(data, offsets)
    code[(code >= 65) & (code <= 90)] += 32
    sep = _SEP[np.minimum(code, 255)]
    newline = code == 10
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(code) and not sep[0]:
        edge = np.concatenate(([0], edge))
    first, after = edge[0::2], edge[1::2]
    upto = np.cumsum(newline)
    keep = ~sep
    inner = after[:-1][upto[first[1:] - 1] == upto[after[:-1] - 1]]
    keep[inner] = True
    code[inner] = 32
    ends = np.flatnonzero(newline)
    kept = np.concatenate(([0], np.cumsum(keep)))
    bounds = np.concatenate(([0], kept[ends]))
    row = np.searchsorted(at, ends, side="right") - 1
    number = np.arange(len(ends)) - np.searchsorted(ends, at[:-1])[row] if len(ends) else ends
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    return code[keep], np.concatenate(([0], bounds[1:][full])), row[full], number[full]


def shingles(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of every line, in order, and the bounds of each line; no line is empty."""
    n = np.diff(bounds)
    out = np.zeros(len(code), dtype=_U)
    wide = code.astype(_U)
    for k in range(SHINGLE):
        out[: len(code) - k] += wide[k:] * _PLACE[k]
    keep = np.ones(len(code), dtype=bool)
    for k in range(1, SHINGLE):
        keep[np.maximum(bounds[1:] - k, bounds[:-1] + 1)[n > 1]] = False
    for i in np.flatnonzero(n < SHINGLE):
        own = wide[bounds[i]: bounds[i + 1]]
        out[bounds[i]: bounds[i] + 1] = (own[None] * _PLACE[: len(own)]).sum(axis=1, dtype=_U) + np.full(1, len(own), dtype=_U) * _STEP
    return B.mix(out[keep]), np.concatenate(([0], np.cumsum(np.maximum(1, n - SHINGLE + 1))))


def fingerprints(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each whole line, in which order counts."""
    own = np.arange(len(code), dtype=_U)
    own -= np.repeat(bounds[:-1].astype(_U), np.diff(bounds))
    own *= _STEP
    own ^= code
    return B.segment_sums(B.mix(own), bounds).view(np.int64)


def distinct(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each of up to CHUNK_LINES lines, ascending, with its bounds."""
    tag = np.repeat(np.arange(len(bounds) - 1, dtype=_U), np.diff(bounds)) << _U(64 - _TAG)
    both = np.sort(tag | (flat >> _U(_TAG)))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    starts = np.searchsorted(both, np.arange(len(bounds) - 1, dtype=_U) << _U(64 - _TAG))
    return both & _U((1 << (64 - _TAG)) - 1), np.append(starts, len(both))


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(bounds) - 1:
        j = int(np.searchsorted(bounds, bounds[i] + CHUNK_SHINGLES, side="right")) - 1
        j = min(max(j, i + 1), i + CHUNK_LINES)
        yield i, j
        i = j


def bands(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(line, band) keys of sets that are not empty."""
    low = (flat & _U(0xFFFFFFFF)).astype(np.uint32)
    work = np.empty_like(low)
    keys = np.zeros((len(bounds) - 1, BANDS), dtype=_U)
    for band in range(BANDS):
        for r in range(BAND_ROWS):
            k = band * BAND_ROWS + r
            np.bitwise_xor(low, _FLIP[k], out=work)
            np.multiply(work, _TIMES[k], out=work)
            keys[:, band] = B.mix(keys[:, band] + np.minimum.reduceat(work, bounds[:-1]).astype(_U), band + 1)
    return keys >> _U(64 - SIG_BITS)


LINES = "row long, doc_id long, line int, node long, n int, sigs binary"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line that is not blank; the first of equal lines of a slice carries the band keys."""
    for batch in batches:
        for i, j, data, off in B.slices(batch["t"], SLICE_BYTES):
            code, bounds, row, number = normalised_lines(data, off)
            if not len(row):
                continue
            flat, at = shingles(code, bounds)
            node = fingerprints(code, bounds)
            _, fresh, back = np.unique(node, return_index=True, return_inverse=True)
            fresh.sort()
            sizes = np.zeros(len(node), dtype=np.int32)
            sigs: list[bytes | None] = [None] * len(node)
            is_fresh = np.zeros(len(node), dtype=bool)
            is_fresh[fresh] = True
            for lo, hi in chunks(at):
                own = np.flatnonzero(is_fresh[lo:hi]) + lo
                if not len(own):
                    continue
                pick = np.repeat(is_fresh[lo:hi], np.diff(at[lo: hi + 1]))
                sets, b = distinct(flat[at[lo]: at[hi]][pick], np.concatenate(([0], np.cumsum(np.diff(at)[own]))))
                sizes[own] = np.diff(b)
                keys = np.ascontiguousarray(bands(sets, b)).view(np.uint8).reshape(len(own), BANDS, 8)[:, :, : SIG_BITS // 8].tobytes()
                step = BANDS * SIG_BITS // 8
                for k, x in enumerate(own):
                    sigs[x] = keys[k * step: (k + 1) * step]
            largest = np.zeros(back.max() + 1, dtype=np.int32)
            largest[back[fresh]] = sizes[fresh]
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays([
                batch["row"].take(take), batch["doc_id"].take(take), pa.array(number.astype(np.int32)), pa.array(node), pa.array(largest[back]),
                pa.array(sigs, pa.binary()),
            ], names=["row", "doc_id", "line", "node", "n", "sigs"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = np.frombuffer(b"".join(batch["sigs"].to_pylist()), dtype=np.uint8).reshape(-1, SIG_BITS // 8)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, : SIG_BITS // 8] = raw
        yield pa.RecordBatch.from_arrays([
            pa.array(wide.view(np.int64).ravel()), pa.array(np.repeat(batch["node"].to_numpy(), BANDS)), pa.array(np.repeat(batch["n"].to_numpy(), BANDS)),
        ], names=["sig", "node", "n"])


def _wanted(needed) -> Callable:
    """(node, t): normalised lines that may be needed, once per slice, as characters of four bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in B.slices(batch["t"], SLICE_BYTES):
                code, bounds, row, _ = normalised_lines(data, off)
                if not len(row):
                    continue
                node = fingerprints(code, bounds)
                fresh = np.unique(node, return_index=True)[1]
                fresh = fresh[is_needed(needed.value, node[fresh])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[fresh]), pa.array([code[bounds[k]: bounds[k + 1]].tobytes() for k in fresh], pa.binary()),
                ], names=["node", "t"])
    return run


def _sets_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(b"".join(lines.to_pylist()), dtype=np.uint32)
    size = np.array([len(x.as_buffer()) // 4 for x in lines], dtype=np.int64)
    return distinct(*shingles(code, np.concatenate(([0], np.cumsum(size)))))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit map of the set of each line."""
    for batch in batches:
        for lo in range(0, len(batch), 512):
            own = batch.slice(lo, 512)
            flat, bounds = _sets_of(own["t"])
            bits = np.zeros((len(own), MAP_BITS), dtype=bool)
            bits[np.repeat(np.arange(len(own)), np.diff(bounds)), (B.mix(flat, 77) & _U(MAP_BITS - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([own["node"], pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["node", "small"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact test of each pair on its whole lines."""
    for batch in batches:
        for lo in range(0, len(batch), 512):
            own = batch.slice(lo, 512)
            (a, at), (b, bt) = _sets_of(own["t_u"]), _sets_of(own["t_v"])
            tag = [np.repeat(np.arange(len(own), dtype=_U), np.diff(x)) << _U(64 - _TAG) for x in (at, bt)]
            both = np.intersect1d(tag[0] | a, tag[1] | b, assume_unique=True) >> _U(64 - _TAG)
            shared = np.bincount(both.astype(np.int64), minlength=len(own))
            keep = pa.array(100 * shared >= 75 * (np.diff(at) + np.diff(bt) - shared))
            yield pa.RecordBatch.from_arrays([own["u"].filter(keep), own["v"].filter(keep)], names=["u", "v"])


def _links(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    as_ = lambda k: lines.select(F.col("node").alias(k), F.col("t").alias(f"t_{k}"))
    return staged(pairs.join(as_("u"), "u").join(as_("v"), "v").select("u", "v", "t_u", "t_v").mapInArrow(_verify, "u long, v long"), "links")


def line_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, doc_id, line, n_shingles, keep_id, keep_line, kept) for every line of `docs` that is not blank.

    `line` counts from 0 in its text, blank lines too. Of each component the line with the smallest id, row and number
    stays, null ids last; keep_id and keep_line name it. Null, empty and blank texts have no lines. Texts and lines of any
    length are read whole. Repeated rows are rows of their own: `row` tells them apart, the column of that name or a
    number given here. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    texts = docs.select(own.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), B.closed_text(text).alias("t"))
    table = staged(texts.mapInArrow(_lines, LINES), "lines")
    found = staged(distinct_pairs(table.where("sigs is not null").select("node", "n", "sigs").mapInArrow(_index, "sig long, node long, n int")), "lists")
    first = staged(found.where("u is not null").select("u", "v").distinct(), "first")
    long = found.where("u is null").select("sig", "node", "n")
    needed = needed_bits(first.select(F.explode(F.array("u", "v")).alias("node")).unionByName(long.select("node")))
    wanted = texts.select("t").mapInArrow(_wanted(docs.sparkSession.sparkContext.broadcast(needed)), "node long, t binary")
    lines = staged(wanted.groupBy("node").agg(F.first("t").alias("t")), "wanted")
    links = _links(first, lines)
    second = later_pairs(long, components(links), lines.mapInArrow(_maps, "node long, small binary"), first, LIST_BLOCK)
    links = links.unionByName(_links(staged(second, "second"), lines))
    linked = components(links)

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    nodes = table.groupBy("node").agg(F.min(place).alias("low")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = nodes.groupBy("component").agg(F.min("low").alias("keep"))
    ids = nodes.join(keep, "component").select("node", "keep")
    return table.join(ids, "node").select(
        "row", "doc_id", "line", F.col("n").cast("long").alias("n_shingles"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.line").alias("keep_line"),
        ((F.col("row") == F.col("keep.row")) & (F.col("line") == F.col("keep.line"))).alias("kept"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, lines in zip(texts, gone):
        taken = set() if lines is None else set(lines.tolist())
        out.append(text if not taken else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in taken))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all of them, with the lines that do not stay taken out of their texts. Columns as before.

    Blank lines stay, null texts stay null. The rows are written once, numbered, so that both readings agree on them.
    """
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("d")), "numbered")
    lines = line_groups(numbered.select("row", F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text")), row="row")
    gone = lines.where("not kept").groupBy("row").agg(F.collect_list("line").alias("gone"))
    rows = numbered.join(gone, "row", "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(_without("d.text", "gone")))
    return rows.select(F.col("d").withField("text", F.col("text")).alias("d")).select("d.*")
