"""Arrow text columns as flat byte arrays: words, word hashes and shingle sets in numpy.

Every function works on a column whose texts end in one separator byte (`closed_text`), so that no word runs from one
text into the next. Texts are read whole; slices only bound how many texts are in memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rule: space and the control characters from tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SHINGLE = 5
SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def closed_text(text: str = "text") -> Column:
    """The text, null as empty, followed by one separator."""
    return F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n"))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a run is over `limit` only if it is one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset: texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a slice."""
    sep = _SEP[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(data) and not sep[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word, with A-Z as a-z if `fold`; worked out over a bounded stretch of bytes at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        lo = starts[i]
        own = data[lo: ends[j - 1]]
        up, down = _Powers.of(len(own))
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[own] if fold else own] * up[: len(own)], dtype=np.uint64, out=sums[1:])
        first, last = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _PLACE[7])
        i = j
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, ascending, as one flat array, and the bounds of each text in it."""
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at)
    n_raw = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n_raw)))
    flat = np.zeros(bounds[-1], dtype=np.uint64)
    if len(words) >= SHINGLE:
        rolled = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            rolled += words[k: len(words) - SHINGLE + 1 + k] * _PLACE[k]
        rolled = mix(rolled)
    long = n_words >= SHINGLE
    keep_from = np.repeat(at[:-1][long] - bounds[:-1][long], n_raw[long])
    place = np.arange(bounds[-1])
    is_long = np.repeat(long, n_raw)
    if long.any():
        flat[is_long] = rolled[place[is_long] + keep_from]
    for d in np.flatnonzero(~long & (n_words > 0)):
        own = words[at[d]: at[d + 1]]
        flat[bounds[d]] = mix(np.array([(own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]), 0x5851F42D4C957F2D)[0]
    for d in range(len(bounds) - 1):
        flat[bounds[d]: bounds[d + 1]].sort()
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[bounds[:-1][n_raw > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return flat[fresh], kept[bounds]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment, 0 for an empty one; integers wrap."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[bounds[1:]] - total[bounds[:-1]]


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets agree, different ones differ but for chance."""
    return (
        segment_sums(mix(flat, 0x1234567), bounds).view(np.int64),
        segment_sums(mix(flat, 0x7654321ABCDEF), bounds).view(np.int64),
    )
