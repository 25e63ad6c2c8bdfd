"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read whole, in overlapping windows of WINDOW words, STRIDE apart. A word enters as the sum of a word vector and
the mean vector of its character three- and four-grams (hashed tables), so unseen forms of a known stem are recognised.
Two gated recurrent layers read a window from both ends, attention pools their states, and a text's score is the
calibrated logit of its most toxic window.

Fitting uses a bounded sample (`SAMPLE` labelled rows of each class, by hash of the id) of the rows that may train: three quarters
of it train the network, one calibrates the score. Labels hold for texts; the windows that train as toxic are those
whose words are over-represented in toxic texts, and clean windows that the network gets wrong are added once. Scoring is
one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.sentencepieces import gather

SAMPLE = 1500
WINDOW, STRIDE = 24, 16
HIDDEN, WIDTH, ATTEND = 8, 12, 8
WORDS, GRAMS = 1 << 14, 1 << 14
STEPS, BATCH = 500, 96
CUTOFF = 0.7
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """The words of a slice: each word's number among the distinct ones, and the hashed features of those."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        cut = _BREAK[data]
        edge = np.flatnonzero(cut[1:] != cut[:-1]) + 1
        if len(data) and not cut[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(starts, offsets)
        hashes, first, self.number = np.unique(B.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.word = (hashes & np.uint64(WORDS - 1)).astype(np.int64)
        s, n = starts[first], ends[first] - starts[first]
        marked = n + 2
        at = np.concatenate(([0], np.cumsum(marked)))
        low = np.full(at[-1], 32, dtype=np.uint32)
        body, _ = gather(B._LOWER[data], s, n, np.arange(len(s)))
        low[np.arange(len(body)) + np.repeat(at[:-1] + 1 - (np.cumsum(n) - n), n)] = body
        grams, owner = [], []
        where = np.repeat(np.arange(len(n), dtype=np.int32), marked)
        for size in (3, 4):
            if len(low) < size:
                continue
            code = np.zeros(len(low) - size + 1, dtype=np.uint32)
            for k in range(size):
                code = code * np.uint32(16777619) ^ (low[k: len(low) - size + 1 + k] + np.uint32(257 * size))
            inside = where[: len(code)] == where[size - 1:]
            grams.append(((code * np.uint32(2654435761)) >> np.uint32(18))[inside].astype(np.int32))
            owner.append(where[: len(code)][inside])
        grams, owner = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (grams, owner))
        by = np.argsort(owner, kind="stable")
        self.grams, self.owner = grams[by], owner[by]
        self.gram_bounds = np.searchsorted(self.owner, np.arange(len(n) + 1))

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        total = np.zeros((len(self.grams) + 1, WIDTH), dtype=np.float32)
        np.cumsum(p["chars"][self.grams], axis=0, out=total[1:], dtype=np.float32)
        count = np.maximum(np.diff(self.gram_bounds), 1)[:, None].astype(np.float32)
        return p["words"][self.word] + (total[self.gram_bounds[1:]] - total[self.gram_bounds[:-1]]) / count

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of each window, -1 beyond the text's end, and the text of each window. The last window of
        a long text ends with the text; a text without words has none."""
        n = np.diff(self.bounds)
        per = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        owner = np.repeat(np.arange(len(n)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.minimum(nth * STRIDE, np.maximum(n[owner] - WINDOW, 0))
        place = start[:, None] + np.arange(WINDOW)[None, :]
        return np.where(place < n[owner][:, None], place + self.bounds[:-1][owner][:, None], -1), owner


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"words": rng.normal(0, 0.1, (WORDS, WIDTH)), "chars": rng.normal(0, 0.3, (GRAMS, WIDTH))}
    for d in ("f", "b"):
        p["w" + d] = rng.normal(0, 0.4, (WIDTH, 3 * HIDDEN))
        p["u" + d] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p["c" + d] = np.zeros(3 * HIDDEN)
    p |= {"wa": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "ba": np.zeros(ATTEND), "va": rng.normal(0, 0.5, ATTEND), "wo": rng.normal(0, 0.5, 2 * HIDDEN), "bo": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _layer(a: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """States of one direction; `a` is (time, window, 3 HIDDEN), already projected."""
    h = np.zeros((a.shape[1], HIDDEN), dtype=np.float32)
    out, saved = np.empty((*a.shape[:2], HIDDEN), dtype=np.float32), []
    for t in range(len(a)):
        hu = h @ u
        gates = _sigmoid(a[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        g = hu[:, 2 * HIDDEN:]
        n = np.tanh(a[t, :, 2 * HIDDEN:] + r * g)
        new = n + z * (h - n)
        new = np.where(mask[t], new, h)
        if keep:
            saved.append((h, z, r, g, n))
        h = out[t] = new
    return out, saved


def _forward(p, table_f, table_b, index, keep: bool = False):
    """Logits of windows; `index` is (window, time) into the projected tables, -1 for padding."""
    at, mask = np.maximum(index, 0).T, (index >= 0).T[:, :, None]
    f, sf = _layer(table_f[at], mask, p["uf"], keep)
    b, sb = _layer(table_b[at[::-1]], mask[::-1], p["ub"], keep)
    h = np.concatenate((f, b[::-1]), axis=2)
    e = np.tanh(h @ p["wa"] + p["ba"])
    s = np.where(mask[:, :, 0], e @ p["va"], np.float32(-1e9))
    s = np.exp(s - s.max(axis=0))
    att = s / s.sum(axis=0)
    c = (att[:, :, None] * h).sum(axis=0)
    return c @ p["wo"] + p["bo"][0], (at, mask, f, sf, b, sb, h, e, att, c)


def _layer_back(dout, saved, mask, u):
    da, du, dh = np.empty((len(saved), dout.shape[1], 3 * HIDDEN), dtype=np.float32), np.zeros_like(u), np.zeros_like(dout[0])
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, g, n = saved[t]
        d = dh + dout[t]
        new = d * mask[t]
        dh = d - new + new * z
        dan = new * (1 - z) * (1 - n * n)
        daz, dar, dg = new * (h - n) * z * (1 - z), dan * g * r * (1 - r), dan * r
        da[t, :, :HIDDEN], da[t, :, HIDDEN: 2 * HIDDEN], da[t, :, 2 * HIDDEN:] = daz, dar, dan
        back = np.concatenate((daz, dar, dg), axis=1)
        du += h.T @ back
        dh = dh + back @ u.T
    return da, du


def gradients(p, words: Words, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of the windows and its gradients; `x` are the vectors of the distinct words."""
    logit, (at, mask, f, sf, b, sb, h, e, att, c) = _forward(p, x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"], index, keep=True)
    q = _sigmoid(logit)
    loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
    d = ((q - y) / len(y)).astype(np.float32)
    g = {"wo": c.T @ d, "bo": np.array([d.sum()])}
    dc = d[:, None] * p["wo"]
    datt = (h * dc[None]).sum(axis=2)
    ds = att * (datt - (att * datt).sum(axis=0))
    de = ds[:, :, None] * p["va"] * (1 - e * e)
    g["va"] = (e * ds[:, :, None]).sum(axis=(0, 1))
    g["wa"], g["ba"] = np.tensordot(h, de, axes=((0, 1), (0, 1))), de.sum(axis=(0, 1))
    dh = att[:, :, None] * dc[None] + de @ p["wa"].T
    dx = np.zeros_like(x)
    for key, out, saved, where, m in (("f", dh[:, :, :HIDDEN], sf, at, mask), ("b", dh[::-1, :, HIDDEN:], sb, at[::-1], mask[::-1])):
        da, g["u" + key] = _layer_back(out, saved, m, p["u" + key])
        flat = (da * m).reshape(-1, 3 * HIDDEN)
        g["c" + key] = flat.sum(axis=0)
        place = where.reshape(-1)
        g["w" + key] = x[place].T @ flat
        np.add.at(dx, place, flat @ p["w" + key].T)
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], words.word, dx)
    count = np.maximum(np.diff(words.gram_bounds), 1)[:, None]
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], words.grams, (dx / count)[words.owner])
    return loss, g


class _Adam:
    def __init__(self, p):
        self.m, self.v, self.t = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2)), None, 0
        self.m, self.v = list(self.m)

    def step(self, p, g, rate):
        self.t += 1
        scale = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def window_logits(p, words: Words, index: np.ndarray) -> np.ndarray:
    x = words.vectors(p)
    f, b = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]
    number = np.where(index >= 0, words.number[np.maximum(index, 0)], -1)
    out = [_forward(p, f, b, number[k: k + 4096])[0] for k in range(0, len(number), 4096)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


def text_logits(p, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest window logit of each text; a text without words has the network's bias."""
    words = Words(data, offsets)
    index, owner = words.windows()
    best = np.full(len(offsets) - 1, p["bo"][0], dtype=np.float64)
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        best[owner[first]] = np.maximum.reduceat(window_logits(p, words, index), first)
    return best


def _sub(words: Words, numbers: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words of some windows as a smaller vocabulary, and the windows in its numbers."""
    real = numbers >= 0
    distinct, inverse = np.unique(numbers[real], return_inverse=True)
    small = object.__new__(Words)
    small.word = words.word[distinct]
    n = np.diff(words.gram_bounds)
    small.grams, small.gram_bounds = gather(words.grams, words.gram_bounds[:-1], n, distinct)
    small.owner = np.repeat(np.arange(len(distinct)), n[distinct])
    out = np.full_like(numbers, -1)
    out[real] = inverse
    return small, out


def _some_logits(p, words: Words, numbers: np.ndarray) -> np.ndarray:
    small, own = _sub(words, numbers)
    x = small.vectors(p)
    return _forward(p, x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"], own)[0]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Parameters and calibration from labelled texts; None if a class is missing."""
    labels = np.asarray(labels, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    closed = pa.array([f"{t}\n" for t in texts], pa.large_string())
    (_, _, data, offsets), = B.slices(closed, 1 << 40)
    words = Words(data, offsets)
    index, owner = words.windows()
    if not len(owner):
        return None
    number = np.where(index >= 0, words.number[np.maximum(index, 0)], -1)
    fits = np.arange(len(labels)) % 4 != 0
    # How much more often a word is in toxic texts than in clean ones, among the texts that train.
    text_of = np.repeat(np.arange(len(labels)), np.diff(words.bounds))
    seen = np.divmod(np.unique(text_of * len(words.word) + words.number), len(words.word))
    seen = [x[fits[seen[0]]] for x in seen]
    freq = [np.bincount(seen[1][labels[seen[0]] == c], minlength=len(words.word)) for c in (0, 1)]
    odds = np.log((freq[1] + 1) / (labels[fits].sum() + 2)) - np.log((freq[0] + 1) / ((1 - labels[fits]).sum() + 2))
    told = np.where(number >= 0, odds[np.maximum(number, 0)], -9).max(axis=1)
    toxic = fits[owner] & (labels[owner] == 1)
    order = np.lexsort((-told, owner))
    rank = np.empty(len(order), dtype=np.int64)
    first = np.searchsorted(owner, owner)
    rank[order] = np.arange(len(order)) - first[order]
    good = np.flatnonzero(toxic & ((rank == 0) & (told > 1.0) | (told > 2.5)))
    clean = np.flatnonzero(fits[owner] & (labels[owner] == 0))
    if not len(good) or not len(clean):
        return None
    p = fresh_parameters(rng)
    adam = _Adam(p)
    hard = clean
    for step in range(STEPS):
        if step == STEPS // 2:
            some = rng.permutation(clean)[:20_000]
            wrong = np.concatenate([_some_logits(p, words, number[some[k: k + 2048]]) for k in range(0, len(some), 2048)])
            hard = some[np.argsort(-wrong)[: max(len(some) // 20, 1)]]
        n = BATCH // 3
        pick = np.concatenate((rng.choice(good, n), rng.choice(clean, n), rng.choice(hard, n)))
        small, own = _sub(words, number[pick])
        y = labels[owner[pick]].astype(np.float32)
        _, g = gradients(p, small, small.vectors(p), own, y)
        adam.step(p, g, 0.01 if step < STEPS * 3 // 4 else 0.003)
    # Calibration on the other quarter: logistic regression on the largest logit.
    # Targets are drawn in a little (Platt), so that separable classes keep finite scores.
    rest = closed.filter(pa.array(~fits))
    del words, index, number, data, closed
    logit = np.concatenate([text_logits(p, d, o) for _, _, d, o in B.slices(rest, 1 << 20)])
    y = labels[~fits]
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mean, spread = logit.mean(), logit.std() + 1e-6
    design = np.stack([(logit - mean) / spread, np.ones(len(logit))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(design @ beta)
        hess = design.T @ (design * np.maximum(q * (1 - q), 1e-3)[:, None]) + 0.1 * np.eye(2)
        beta -= np.linalg.solve(hess, design.T @ (q - target) + 0.1 * beta)
    a, b = beta[0] / spread, beta[1] - beta[0] * mean / spread
    p["scale"] = np.array([max(a, 1e-3), b])
    return p


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            for i, j, data, offsets in B.slices(batch["t"], 1 << 20):
                if p is None:
                    score = np.full(j - i, 0.5)
                else:
                    score = _sigmoid(p["scale"][0] * text_logits(p, data, offsets) + p["scale"][1])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), batch["held_out"].slice(i, j - i), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    Labels count from rows with crc32(id as text) mod 3 other than 1 only; a null label or id is no label, and of several
    labels the largest counts. A null or empty text, or one without words, gets the score of the network's bias. If a class has no
    labelled rows every score is 0.5. Repeated rows and null ids are scored like any other. An empty table gives an empty
    result. Other columns are ignored, whatever their names; language, source and id are no inputs of a score.
    """
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), held_out()).where("not held_out")
    may = may.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most 2 * sample ids, and as many texts, reach the driver.
    part = lambda c: may.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(part(1).unionByName(part(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    found = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect()), key=lambda r: (r[2], r[0], r[1]))
    model = train([r[1] for r in found], np.array([r[2] for r in found]))
    if model is not None:
        # The sample has as many rows of each class; the share of toxic rows among all that may train corrects for it.
        of = {r["toxic"]: r["count"] for r in may.groupBy("toxic").count().collect()}
        taken = [sum(r[2] == c for r in found) for c in (0, 1)]
        model["scale"][1] += np.log(of[1] / of[0]) - np.log(taken[1] / taken[0])
    model = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(), B.closed_text("text").alias("t"))
    return texts.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
