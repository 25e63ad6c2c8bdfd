"""Periodic runs of words by seed-and-extend diagonals.

A run is a longest stretch of words in which words q apart are identical, q its smallest period, of at least
max(LEAST, TIMES * q) words. On the diagonal of lag q it is a stretch of at least max(LEAST, TIMES * q) - q matches.

Method. Lags are taken in bands from `low` to 1.5 * `low`. Every run with a period of the band has all words of a k-gram
match on its diagonal, k = max(5, 3 * low): the least overlap that the band guarantees. The k-grams of a document are
indexed, and each occurrence is paired with the next one of the same document. That loses no run and pairs no two
occurrences further apart: k is at least 2q - 1, so an occurrence in between would give the run a smaller period. Pairs
whose distance lies in the band are seeds; neighbouring seeds of a lag are one. A table with the furthest position covered
at each lag leaves out a seed inside a stretch that is known; the others are extended in both directions word by word.
A position stays in the index only while its gram occurs twice, for a longer gram repeats only where the shorter one does;
so plain prose is indexed once, and work is near linear for texts of one repeated word as well. Grams of a band are named
by two overlapping grams of the band before.

Plan. One pass over the texts, no shuffle; texts of a slice are worked on together. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B

LEAST, TIMES = 6, 4
SEED_WORDS = 5

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_PLACE = _RNG.integers(1, 2**63, SEED_WORDS, dtype=_U) | _U(1)
_LEFT, _RIGHT = _RNG.integers(1, 2**63, 2, dtype=_U) | _U(1)


def bands(words: int) -> Iterator[tuple[int, int, int]]:
    """(lowest lag, highest lag, gram) of every band that a text of so many words can hold a run of."""
    low, high, gram = 1, 2, SEED_WORDS
    while max(LEAST, TIMES * low) <= words:
        yield low, high, gram
        low = high + 1
        high, gram = 3 * low // 2, 3 * low


def _matches(words: np.ndarray, at: int, step: int, lag: int, stop: int) -> int:
    """How many words from `at` on, in direction `step`, equal the word `lag` after them; `stop` is not passed."""
    done, chunk = 0, 16
    while (left := (stop - at) * step - done) > 0:
        n = min(chunk, left)
        x = np.arange(n) * step + at + done * step
        same = words[x] == words[x + lag]
        if not same.all():
            return done + int(np.argmin(same))
        done += n
        chunk *= 4
    return done


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of every run, ascending; `bounds` says which words belong to which text."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    stop = bounds[1:][text]
    own = np.arange(len(words))
    found: list[tuple[int, int, int, int]] = []
    covered: dict[int, int] = {}
    at = own[own + SEED_WORDS <= stop]
    alone = B.mix(own.astype(_U), 0x51)
    grams = alone.copy()
    if len(at):
        rolled = B.mix(text[at].astype(_U), 0x77)
        for k in range(SEED_WORDS):
            rolled += words[at + k] * _PLACE[k]
        grams[at] = B.mix(rolled)
    width = SEED_WORDS
    for low, high, gram in bands(int(counts.max(initial=0))):
        inside = (counts[text[at]] >= TIMES * low) & (at + gram <= stop[at])
        gone, at = at[~inside], at[inside]
        if not len(at):
            break
        key = grams[at] if gram == width else B.mix(grams[at] * _LEFT + grams[at + gram - width] * _RIGHT + _U(gram))
        grams[at], grams[gone], width = key, alone[gone], gram
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        first, lag = place[:-1][same], (place[1:] - place[:-1])[same]
        fits = (lag >= low) & (lag <= high)
        first, lag = first[fits], lag[fits]
        by = np.lexsort((first, lag))
        first, lag = first[by], lag[by]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        heads = np.flatnonzero(new)
        for i, last, d in zip(first[heads].tolist(), first[np.append(heads[1:], len(first)) - 1].tolist() if len(first) else [], lag[heads].tolist()):
            if i < covered.get(d, -1):
                continue
            t = int(text[i])
            start = i - _matches(words, i - 1, -1, d, int(bounds[t]) - 1)
            end = last + gram
            end += _matches(words, end, 1, d, int(bounds[t + 1]) - d)
            covered[d] = end
            if end - start + d >= max(LEAST, TIMES * d):
                found.append((t, start - int(bounds[t]), end - start + d, d))
        at = np.sort(place[again])
        grams[place[~again]] = alone[place[~again]]
    return np.array(sorted(found, key=lambda x: (x[0], x[1], x[3])), dtype=np.int64).reshape(-1, 4)


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each text without the words that a run contains after its first period, the others joined by one space."""
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    base = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, base + runs[:, 3], 1)
    np.add.at(edge, base + runs[:, 2], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.concatenate(([0], np.cumsum(keep)))[bounds]
    starts, lengths = starts[keep], (ends - starts)[keep] + 1
    last = kept[1:][kept[1:] > kept[:-1]] - 1
    lengths[last] -= 1
    upto = np.concatenate(([0], np.cumsum(lengths)))
    out = data[np.arange(upto[-1]) - np.repeat(upto[:-1] - starts, lengths)]
    space = np.ones(len(lengths), dtype=bool)
    space[last] = False
    out[upto[1:][space] - 1] = 0x20
    return pa.LargeStringArray.from_buffers(len(kept) - 1, pa.py_buffer(upto[kept]), pa.py_buffer(out))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in B.slices(batch["t"]):
            starts, ends = B.word_bounds(data)
            bounds = np.searchsorted(starts, offsets)
            runs = runs_of(B.word_hashes(data, starts, ends, fold=False), bounds)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(runs[:, 0], np.arange(j - i + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(i, j - i), pa.array(np.diff(bounds)), lists, collapsed(data, starts, ends, bounds, runs).cast(pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of `docs`.

    `runs` has start, length and period of each run, in words from 0, by start, then period. `collapsed` is the text with
    the repetitions of its runs left out, words joined by one space. Null and empty texts, and texts of white space, have
    no words, no runs and an empty `collapsed`. Ids may be null or repeated; every row counts by itself. Texts of any
    length are read whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), B.closed_text(text).alias("t")).mapInArrow(
        _scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def best_run(runs: str = "runs"):
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    longer = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.col(runs), F.element_at(F.col(runs), 1), lambda best, x: F.when(longer(x, best), x).otherwise(best))
