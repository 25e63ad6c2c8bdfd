"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces, and an end byte. Each byte is eight binary decisions. For every
context of 0 to DEPTH preceding bytes and every decision in it, the training texts give counts, a Krichevsky-Trofimov
estimate and its block probability; block probabilities of a context and of its longer contexts are weighted half and
half, from the longest up. The weight that a context keeps for its own estimate mixes the estimates of all depths when a
text is scored; depths that training has not seen take no part. The sum of the log probabilities is the code length.

Plan. Texts are packed into chunks of a few megabytes, written once. A chunk reduces itself to its distinct byte
sequences and words with their training counts; only those shuffle. The counts are summed over the corpus, sequences are
gathered by the last two context bytes so that each group holds whole subtrees, and the two shallowest depths (at most
65,280 nodes) are summed for all. The log probability of each distinct sequence then goes back to the chunks that hold it,
where texts are scored by lookup. Nothing is broadcast but tables over an alphabet of bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.shared import staged

#: A sequence, the context and its next byte, fits 56 bits of a long.
DEPTH = 6
CHUNK_BYTES = 8 << 20
#: Groups of context endings that are worked on at once.
BUCKETS = 1024
END = 10
#: Cells of the direct tables that number sequences; more distinct ones are numbered by sorting.
_DIRECT = 1 << 26
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1, dtype=np.int32)


def pack(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical bytes of all texts of a slice end to end, and their lengths; each ends in the end byte."""
    starts, ends = B.word_bounds(data)
    out, keep = B._LOWER[data], ~B._SEP[data]
    keep[ends] = True
    out[ends] = 32
    at = np.searchsorted(starts, offsets)
    some = np.diff(at) > 0
    out[ends[at[1:][some] - 1]] = END
    keep[offsets[1:][~some] - 1] = True
    out[offsets[1:][~some] - 1] = END
    return out[keep], np.diff(np.concatenate(([0], np.cumsum(keep)))[offsets])


CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<long>, body binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, sizes, bodies, total, seq = [], [], [], [], 0, TaskContext.get().partitionId() << 32

    def flush():
        nonlocal ids, held, sizes, bodies, total, seq
        yield pa.RecordBatch.from_arrays([
            pa.array([seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([zlib.compress(b"".join(bodies), 1)], pa.binary()),
        ], names=["chunk", "doc_ids", "held", "sizes", "body"])
        ids, held, sizes, bodies, total, seq = [], [], [], [], 0, seq + 1

    for batch in batches:
        for i, j, data, offsets in B.slices(batch["t"]):
            packed, lengths = pack(data, offsets)
            if total and total + len(packed) > CHUNK_BYTES:
                yield from flush()
            ids += batch["doc_id"].slice(i, j - i).to_pylist()
            held += batch["held"].slice(i, j - i).to_pylist()
            sizes += lengths.tolist()
            bodies.append(packed.tobytes())
            total += len(packed)
    if ids:
        yield from flush()


class Chunk:
    """A chunk's sequences of DEPTH + 1 bytes and its words, each numbered, with the values behind the numbers."""

    def __init__(self, body: bytes, sizes: np.ndarray, held: np.ndarray) -> None:
        data = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
        self.sizes, n = sizes, len(sizes)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        padded = np.full(len(data) + DEPTH * n, END, dtype=np.uint8)
        inside = np.repeat(np.tile([False, True], n), np.stack([np.full(n, DEPTH), sizes], axis=1).ravel())
        padded[inside] = data
        numbers, self.codes = _numbered(padded)
        # The sequence of a byte starts DEPTH places before it.
        self.grams = numbers[inside[DEPTH:]]
        del numbers, padded, inside
        self.train_byte = np.repeat(~held, sizes)
        first, last = B.word_bounds(data)
        self.word_at = np.searchsorted(first, self.bounds)
        self.hashes, self.words = np.unique((B.word_hashes(data, first, last) >> np.uint64(2)).astype(np.int64), return_inverse=True)
        self.train_word = np.repeat(~held, np.diff(self.word_at))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts: sequences as they are, words below zero."""
        seen = np.bincount(self.grams, minlength=len(self.codes)) > 0
        gram = np.bincount(self.grams[self.train_byte], minlength=len(self.codes))[seen]
        word = np.bincount(self.words[self.train_word], minlength=len(self.hashes))
        return np.concatenate((self.codes[seen], -1 - self.hashes)), np.concatenate((gram, word))


def _numbered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the sequence that starts at each place, and the bytes behind each number as one integer."""
    used = np.flatnonzero(np.bincount(data, minlength=256))
    letter = np.zeros(256, dtype=np.int32)
    letter[used] = np.arange(len(used))
    single = letter[data]
    ids, codes = single, used.astype(np.int64)
    for k in range(1, DEPTH + 1):
        span = len(codes) * len(used)
        both = ids[: len(ids) - 1].astype(np.int32 if span < 1 << 31 else np.int64) * len(used) + single[k:]
        if span <= _DIRECT:
            flag = np.zeros(span, dtype=bool)
            flag[both] = True
            distinct = np.flatnonzero(flag)
            # A number is the count of set cells before it: those of earlier groups of eight, and those of its own.
            packed = np.packbits(flag, bitorder="little")
            before = np.cumsum(_BITS[packed], dtype=np.int32) - _BITS[packed]
            group = both >> 3
            ids = before[group] + _BITS[packed[group] & ((1 << (both & 7)) - 1)]
        else:
            distinct, ids = np.unique(both, return_inverse=True)
            ids = ids.astype(np.int32)
        distinct = distinct.astype(np.int64)
        codes = codes[distinct // len(used)] << 8 | used[distinct % len(used)]
    return ids, codes


def _open(body, sizes, held) -> Chunk:
    return Chunk(body, np.array(sizes, dtype=np.int64), np.array(held, dtype=bool))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch[c][k].as_py() for c in ("chunk", "body", "sizes", "held")}
            keys, counts = _open(row["body"], row["sizes"], row["held"]).counts()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["chunk"])), pa.array(keys), pa.array(counts)], names=["chunk", "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, by Stirling's series above 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability of the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 2 * log_gamma(np.array(0.5))


class Level:
    """The decisions of all contexts of one depth among some sequences."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int) -> None:
        context, byte = codes >> 8 & (1 << 8 * depth) - 1, codes & 255
        node = [context << 8 | 1 << k | byte >> 8 - k for k in range(8)]
        self.bit = np.concatenate([byte >> 7 - k & 1 for k in range(8)])
        self.keys, self.at = np.unique(np.concatenate(node), return_inverse=True)
        weight = np.tile(counts.astype(np.float64), 8)
        self.ones = np.bincount(self.at, weights=weight * self.bit, minlength=len(self.keys))
        self.zeros = np.bincount(self.at, weights=weight, minlength=len(self.keys)) - self.ones
        self.depth = depth
        self.own = log_kt(self.zeros, self.ones)
        self.whole, self.stop = self.own, np.ones(len(self.keys))

    def below(self, deeper: Level) -> None:
        """Weight with the product over the longer contexts."""
        context = deeper.keys >> 8 & (1 << 8 * self.depth) - 1
        parent = np.searchsorted(self.keys, context << 8 | deeper.keys & 255)
        self.weigh(np.bincount(parent, weights=deeper.whole, minlength=len(self.keys)))

    def weigh(self, under: np.ndarray) -> None:
        self.whole = np.logaddexp(self.own, under) - np.log(2)
        self.stop = np.exp(self.own - np.log(2) - self.whole)


def _levels(codes: np.ndarray, counts: np.ndarray, shallowest: int) -> dict[int, Level]:
    out: dict[int, Level] = {}
    for depth in range(DEPTH, shallowest - 1, -1):
        out[depth] = Level(codes, counts, depth)
        if depth < DEPTH:
            out[depth].below(out[depth + 1])
    return out


def _second(table: pa.Table) -> pa.Table:
    """Depth-two decisions of a bucket, for the sums of the shallower depths."""
    level = _levels(table["key"].to_numpy(), table["c"].to_numpy(), 2)[2]
    return pa.table({"key": level.keys & 0xFFFF, "zeros": level.zeros, "ones": level.ones, "whole": level.whole})


class Shallow:
    """Depths 0 and 1 for all: estimate of a one, weight of the own estimate, whether seen."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, under: np.ndarray) -> None:
        self.p, self.stop, self.seen = {}, {}, {}
        for depth, cells in ((1, 1 << 16), (0, 1 << 8)):
            at = key & cells - 1
            z, o, u = (np.bincount(at, weights=x, minlength=cells) for x in (zeros, ones, under))
            own = log_kt(z, o)
            whole = np.logaddexp(own, u) - np.log(2)
            self.p[depth], self.stop[depth], self.seen[depth] = (o + 0.5) / (z + o + 1), np.exp(own - np.log(2) - whole), z + o > 0
            key, zeros, ones, under = np.arange(cells), z, o, whole


def log10_probabilities(codes: np.ndarray, counts: np.ndarray, shallow: Shallow) -> np.ndarray:
    """log10 probability of the last byte of each sequence after the others."""
    levels = _levels(codes, counts, 2)
    node = np.concatenate([codes >> 8 << 8 | 1 << k | (codes & 255) >> 8 - k for k in range(8)])
    p, seen = None, None
    for depth in range(DEPTH, -1, -1):
        if depth >= 2:
            level = levels[depth]
            own = ((level.ones + 0.5) / (level.zeros + level.ones + 1))[level.at]
            stop, some, bit = level.stop[level.at], (level.zeros + level.ones > 0)[level.at], level.bit
        else:
            at = node & (1 << 8 * (depth + 1)) - 1
            own, stop, some = shallow.p[depth][at], shallow.stop[depth][at], shallow.seen[depth][at]
        p = own if p is None else np.where(seen, stop * own + (1 - stop) * p, own)
        seen = some
    return np.log10(np.where(bit == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)


def _score(constants: dict):
    tokens, kinds, ends = constants["tokens"], constants["kinds"], constants["ends"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scale = tokens + 0.5 * (kinds + 1)
        parts = []
        key, value = right["key"].to_numpy(), right["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        for k in range(len(left)):
            row = {c: left[c][k].as_py() for c in ("doc_ids", "body", "sizes", "held")}
            chunk = _open(row["body"], row["sizes"], row["held"])
            place = np.minimum(np.searchsorted(key, chunk.codes), max(len(key) - 1, 0))
            logs = np.where(key[place] == chunk.codes, value[place], 0.0)
            score = np.add.reduceat(logs[chunk.grams], chunk.bounds[:-1])  # no text is without its end byte
            own = np.bincount(chunk.words[chunk.train_word], minlength=len(chunk.hashes)).astype(np.float64)
            place = np.minimum(np.searchsorted(key, -1 - chunk.hashes), max(len(key) - 1, 0))
            total = np.where(key[place] == -1 - chunk.hashes, value[place], own) if len(chunk.hashes) else own
            words = np.diff(chunk.word_at)
            base = B.segment_sums(np.log10((total + 0.5) / scale)[chunk.words], chunk.word_at) + np.log10((ends + 0.5) / scale)
            known = B.segment_sums((total > 0).astype(np.int64)[chunk.words], chunk.word_at) + (ends > 0)
            parts.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"]), "n_tokens": pa.array(words + 1),
                "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(words), tokens)), "base_score": pa.array(base), "score": pa.array(score),
                "code_bits_per_byte": pa.array(-score / np.log10(2) / chunk.sizes),
            }))
        return pa.concat_tables(parts)
    return run


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_bits_per_byte double"


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: SCORE's columns, all logarithms to base 10.

    Rows whose crc32(id as text) mod 5 is 1 are held out of training. A null or empty text, or one of white space, is the
    end alone. A null id counts as the empty text for the remainder, so such a row trains. Repeated rows train as often as
    they occur. An empty table gives an empty result; with no training rows every estimate is a half. Other columns are
    ignored, whatever their names.
    """
    held = (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held, B.closed_text(text).alias("t"))
    chunks = staged(rows.mapInArrow(_chunks, CHUNK), "chunks")
    parts = staged(chunks.mapInArrow(_reduce, "chunk long, key long, n long"), "parts")
    totals = staged(parts.groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")), "totals")
    sums = totals.where("key < 0 and c > 0").agg(F.sum("c"), F.count("*")).first()
    ends = rows.where("not held").count()
    constants = {"tokens": (sums[0] or 0) + ends, "kinds": sums[1] + (ends > 0), "ends": ends}
    grams = totals.where("key >= 0").select("key", "c", F.expr(f"cast((shiftright(key, 8) & 65535) % {BUCKETS} as int)").alias("bucket"))
    # At most 256 x 255 rows.
    second = grams.groupBy("bucket").applyInArrow(_second, "key long, zeros double, ones double, whole double").groupBy("key").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("whole").alias("whole")).toPandas()
    shallow = docs.sparkSession.sparkContext.broadcast(Shallow(*(second[c].to_numpy() for c in ("key", "zeros", "ones", "whole"))))

    def probabilities(t: pa.Table) -> pa.Table:
        codes = t["key"].to_numpy()
        return pa.table({"key": codes, "value": log10_probabilities(codes, t["c"].to_numpy(), shallow.value)})

    logs = grams.groupBy("bucket").applyInArrow(probabilities, "key long, value double")
    words = totals.where("key < 0 and chunks > 1").select("key", F.col("c").cast("double").alias("value"))
    back = parts.select("chunk", "key").join(logs.unionByName(words), "key").select("chunk", "key", "value")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_score(constants), SCORE)
