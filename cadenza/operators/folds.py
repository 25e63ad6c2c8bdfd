"""Greedy sequence building inside the plan: one fold per request.

Each request holds a bounded list of candidates (at most a few dozen), so the
fold is a Catalyst expression and requests are spread over the cluster. `with_picks`
runs the same folds over Arrow batches: a step of all requests of a tile is array arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..functions.encode import md5_unit
from ..functions.vectors import let
from .graph import CLASS, compatible


def candidate_lists(ranked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Candidates of a key in rank order, as one array (bounded by the k of the ranking)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return ranked.groupBy(key).agg(rows.alias("cands"))


def _as_class(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in CLASS}


def transition_greedy(cands: Column, kind: str, steps: int, diversity, weight, opening: int = 20) -> Column:
    """First a `basic` item of the `opening` best, else the best; then arg-max of the adjusted score at each step.

    +0.3 * weight for a compatible follower, times (1 - diversity) when used
    before, +0.2 * diversity when the label is not among the last two.
    """
    empty = F.slice(cands, 1, 0)
    basics = F.filter(cands, lambda c: c["label"].contains("basic") & (c["rank"] <= opening))
    first = F.slice(F.when(F.size(basics) > 0, basics).otherwise(cands), 1, 1)

    def step(picked, i):
        def adjusted(c):
            prev = F.element_at(picked, -1)
            s = c["score"] + F.when(
                compatible(_as_class(prev), _as_class(c)) & (c["item_id"] != prev["item_id"]), weight * 0.3).otherwise(0.0)
            s = F.when(F.exists(picked, lambda p: p["item_id"] == c["item_id"]), s * (1.0 - diversity)).otherwise(s)
            recent = F.slice(picked, -2, 2)
            fresh = ~F.exists(recent, lambda p: p["label"] == c["label"])
            s = s + F.when((i > 1) & fresh, diversity * 0.2).otherwise(0.0)
            return F.struct(F.round(s, 9).alias("s"), (-c["rank"]).alias("r"), c.alias("c"))

        best = F.array_max(F.transform(cands, adjusted))
        return F.concat(picked, F.array(best["c"]))

    # For i > 1 two picks exist, so the slice of the last two is defined.
    def guarded(picked, i):
        return F.when(F.size(picked) == 0, picked).otherwise(step(picked, i))

    start = F.concat(empty, first)
    if steps <= 1:
        return start
    one = let(start, lambda s0: guarded_first(s0, cands, diversity, weight))
    if steps == 2:
        return one
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps - 1)), one, guarded)


def guarded_first(picked: Column, cands: Column, diversity, weight) -> Column:
    """The second pick: no label bonus yet."""
    def adjusted(c):
        prev = F.element_at(picked, -1)
        s = c["score"] + F.when(
            compatible(_as_class(prev), _as_class(c)) & (c["item_id"] != prev["item_id"]), weight * 0.3).otherwise(0.0)
        s = F.when(prev["item_id"] == c["item_id"], s * (1.0 - diversity)).otherwise(s)
        return F.struct(F.round(s, 9).alias("s"), (-c["rank"]).alias("r"), c.alias("c"))

    best = F.array_max(F.transform(cands, adjusted))
    return F.when(F.size(picked) == 0, picked).otherwise(F.concat(picked, F.array(best["c"])))


def transition_of(a: Column, b: Column) -> Column:
    """Energy and difficulty parts of the transition score of two candidates."""
    return scores.ladder(a["energy"], b["energy"], near=0.8, far=0.4) * 0.6 + scores.step_score(a["difficulty"], b["difficulty"]) * 0.4


def section_greedy(cands: Column, sections: Column, at_most: int = 12) -> Column:
    """Per section: first fit after a transition above 0.3, then the best mean of score and transition that fits.

    Goes on while more than 5 seconds are left. `sections` is an array of
    durations; an item takes its own duration. `at_most` bounds the picks of a
    section (a section of s seconds holds at most s / 5 + 1 items).
    """
    empty = F.slice(cands, 1, 0)

    def one_section(done, seconds):
        fit = F.filter(cands, lambda c: c["duration"] <= seconds)
        ok = F.when(
            F.size(done) > 0, F.filter(fit, lambda c: transition_of(F.element_at(done, -1), c) > 0.3)
        ).otherwise(fit)
        first = let(ok, lambda o: F.slice(o, 1, 1))

        def fill(mine, _):
            left = seconds - F.aggregate(mine, F.lit(0.0), lambda t, c: t + c["duration"])

            def rated(c):
                joined = F.when(F.size(mine) > 0, (c["score"] + transition_of(F.element_at(mine, -1), c)) / 2.0).otherwise(c["score"])
                return F.struct(F.round(joined, 9).alias("s"), (-c["rank"]).alias("r"), c.alias("c"))

            free = F.filter(cands, lambda c: (c["duration"] <= left) & ~F.exists(mine, lambda m: m["item_id"] == c["item_id"]))
            best = F.array_max(F.transform(free, rated))
            return let(left, lambda rest: F.when(
                (rest > 5.0) & best.isNotNull(), F.concat(mine, F.array(best["c"]))).otherwise(mine))

        mine = F.aggregate(F.sequence(F.lit(1), F.lit(at_most)), F.concat(empty, first), fill)
        return F.concat(done, mine)

    return F.aggregate(sections, empty, one_section)


def per_step_lists(cands: Column, steps: int, diversity: float, keep: int) -> Column:
    """The list of every step, best first: earlier heads drop out, or stay discounted among the `keep` best candidates."""
    def listed(heads):
        used = lambda c: F.exists(heads, lambda h: h == c["item_id"])
        kept = F.filter(cands, lambda c: (c["rank"] <= keep) | ~used(c))
        score = lambda c: F.round(F.when(used(c), c["score"] * (1.0 - diversity)).otherwise(c["score"]), 9)
        return F.array_sort(F.transform(kept, lambda c: F.struct((-score(c)).alias("s"), c["rank"].alias("r"), c["item_id"].alias("item_id"))))

    def step(heads, _):
        return F.concat(heads, F.array(F.element_at(listed(heads), 1)["item_id"]))

    heads = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), F.slice(F.transform(cands, lambda c: c["item_id"]), 1, 1), step)
    return let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: listed(F.slice(h, F.lit(1), i))))


def usage_balanced(cands: Column, key: Column, steps: Column, seed: int) -> Column:
    """Rotate types, avoid the last two picks, least used first, seeded noise on the score."""
    kinds = F.array_distinct(F.transform(cands, lambda c: c["kind"]))
    return let(kinds, lambda types: _usage_balanced(cands, types, key, steps, seed))


def _usage_balanced(cands, types, key, steps, seed):
    def step(picked, i):
        def u(tag, c):
            return md5_unit(F.concat_ws(":", F.lit(f"{seed}:{tag}"), key.cast("string"), i.cast("string"), c["item_id"].cast("string")))

        def rated(c):
            uses = F.size(F.filter(picked, lambda p: p["item_id"] == c["item_id"]))
            return F.struct(uses.alias("n"), (-c["score"] + u("n", c) * 0.2 - 0.1).alias("s"), c.alias("c"))

        def pick(ranked):
            # Half of the time one of the three best is drawn, weighted towards the rarely used.
            drawn = F.array_min(F.transform(ranked, lambda r: F.struct((-F.log(F.greatest(u("w", r["c"]), F.lit(1e-12))) * (r["n"] + 1)).alias("g"), r["c"].alias("c"))))["c"]
            coin = md5_unit(F.concat_ws(":", F.lit(f"{seed}:c"), key.cast("string"), i.cast("string"))) < 0.5
            return F.concat(picked, F.array(F.when(coin, drawn).otherwise(F.element_at(ranked, 1)["c"])))

        def of_kind(kind, free):
            return let(F.filter(free, lambda c: c["kind"] == kind), lambda same: F.when(F.size(same) > 0, same).when(F.size(free) > 0, free).otherwise(cands))

        # What is read more than once is bound, or it would be worked out for each reading.
        break_rotation = md5_unit(F.concat_ws(":", F.lit(f"{seed}:r"), key.cast("string"), i.cast("string"))) < 0.3
        offset = F.when(break_rotation, F.floor(md5_unit(F.concat_ws(":", F.lit(f"{seed}:t"), key.cast("string"), i.cast("string"))) * F.size(types))).otherwise(i % F.size(types))
        recent = F.slice(picked, F.greatest(F.lit(1), F.size(picked) - 1), F.lit(2))
        free = F.filter(cands, lambda c: ~F.exists(recent, lambda p: p["item_id"] == c["item_id"]))
        return let(F.get(types, offset.cast("int")), lambda kind: let(free, lambda f: let(of_kind(kind, f), lambda pool: let(
            F.slice(F.array_sort(F.transform(pool, rated)), 1, 3), pick))))

    return F.aggregate(F.sequence(F.lit(0), steps - 1), F.slice(cands, 1, 0), step)


# --- the same folds on arrays -------------------------------------------------

#: Requests of one tile, and the digits at which scores are compared.
TILE, DIGITS = 1024, 9
LOW, HIGH = ("low", "beginner"), ("high", "advanced")


class Lists:
    """Candidate lists of a tile as arrays of requests by places, filled up with places that are not `there`."""

    def __init__(self, column: pa.Array, numbers: list[str], words: list[str]):
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        self.n, width = len(column), int(size.max(initial=0))
        self.there = np.arange(width)[None, :] < size[:, None]
        self.dictionary: dict[str, list[str]] = {}
        for name in [*numbers, *words]:
            values = flat.field(name)
            if name in words:
                coded = values.dictionary_encode()
                self.dictionary[name] = coded.dictionary.to_pylist()
                values = coded.indices
            values = values.to_numpy(zero_copy_only=False)
            padded = np.zeros((self.n, width), dtype=values.dtype)
            padded[self.there] = values
            setattr(self, name, padded)

    def told(self, name: str, rule: Callable[[str], object]) -> np.ndarray:
        """What `rule` says of the words of a column."""
        return np.array([rule(w) for w in self.dictionary[name]])[getattr(self, name)]

    def level(self, name: str) -> np.ndarray:
        return self.told(name, lambda w: 1.0 if w.lower() in LOW else 3.0 if w.lower() in HIGH else 2.0)


def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def _best(score: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Place of the highest score of each row, the first of equal ones; -1 where none is ok. Places are in order of rank."""
    s = np.where(ok, _round(score), -np.inf)
    return np.where(ok.any(axis=1), np.argmax(s, axis=1), -1)


def with_picks(df: DataFrame, fold: Callable, numbers: list[str], words: list[str], given: dict[str, Column] | None = None, name: str = "picked") -> DataFrame:
    """`df` with the candidates (column `cands`) that `fold` picks, in order, as one array.

    `fold` takes the lists of a tile and the `given` columns as arrays and returns places, requests by steps, -1 for none.
    """
    given = given or {}
    asked = list(given)
    df = df.withColumns({f"_{c}": v for c, v in given.items()})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                cols = {c: _given(part.column(part.schema.get_field_index(f"_{c}"))) for c in asked}
                lists = Lists(part.column(part.schema.get_field_index("cands")), numbers, words)
                places = fold(lists, **cols) if lists.there.any() else np.full((lists.n, 1), -1)
                ends = np.concatenate(([0], np.cumsum((places >= 0).sum(axis=1))))
                at_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places[places >= 0], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, at_], names=[*part.schema.names, "_at"])

    schema = T.StructType([*df.schema.fields, T.StructField("_at", T.ArrayType(T.IntegerType()))])
    out = df.mapInArrow(run, schema).withColumn(name, F.transform("_at", lambda i: F.get("cands", i)))
    return out.drop("_at", *[f"_{c}" for c in asked])


def _given(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def greedy_places(c: Lists, steps: int, diversity: np.ndarray, weight: np.ndarray, opening: int = 20) -> np.ndarray:
    """As `transition_greedy`."""
    all_, energy, difficulty = np.arange(c.n), c.level("energy"), c.level("difficulty")
    is_basic_step = c.told("label", lambda w: w == "basic_step")
    turns = c.told("label", lambda w: "turn" in w or w in ("cross_body_lead", "double_cross_body_lead"))
    easy = c.told("label", lambda w: "turn" in w or w == "basic_step")
    basic = c.told("label", lambda w: "basic" in w) & (c.rank <= opening) & c.there
    picked = np.full((c.n, steps), -1)
    picked[:, 0] = np.where(basic.any(axis=1), basic.argmax(axis=1), np.where(c.there.any(axis=1), 0, -1))
    used = np.zeros(c.there.shape, dtype=bool)
    for i in range(1, steps):
        prev = picked[:, i - 1]
        at = (all_, np.maximum(prev, 0))
        same = c.item_id == c.item_id[at][:, None]
        used |= same
        near = (np.abs(energy - energy[at][:, None]) <= 1) | (np.abs(difficulty - difficulty[at][:, None]) <= 1)
        fits = near | is_basic_step[at][:, None] | (turns[at][:, None] & easy)
        s = c.score + np.where(fits & ~same, weight[:, None] * 0.3, 0.0)
        s = np.where(used, s * (1.0 - diversity[:, None]), s)
        if i > 1:
            before = (all_, np.maximum(picked[:, i - 2], 0))
            fresh = (c.label != c.label[at][:, None]) & (c.label != c.label[before][:, None])
            s = s + np.where(fresh, diversity[:, None] * 0.2, 0.0)
        picked[:, i] = np.where(prev >= 0, _best(s, c.there), -1)
    return picked


def section_places(c: Lists, sections: np.ndarray, at_most: int = 12) -> np.ndarray:
    """As `section_greedy`."""
    all_, energy, difficulty = np.arange(c.n), c.level("energy"), c.level("difficulty")
    ladder, up = np.array([1.0, 0.8, 0.4]), np.array([0.3, 0.7, 1.0, 0.9, 0.5])  # energies by distance, difficulties by step from -2 to 2

    def transition(last):
        at = (all_, np.maximum(last, 0))
        gap = np.abs(energy - energy[at][:, None]).astype(np.int64)
        return ladder[gap] * 0.6 + up[(difficulty - difficulty[at][:, None]).astype(np.int64) + 2] * 0.4

    out, last = [], np.full(c.n, -1)
    for k in range(sections.shape[1]):
        seconds = sections[:, k]
        ok = c.there & (c.duration <= seconds[:, None]) & ((last < 0)[:, None] | (transition(last) > 0.3))
        pick = np.where(ok.any(axis=1), ok.argmax(axis=1), -1)
        mine, used, total = np.full(c.n, -1), np.zeros(c.there.shape, dtype=bool), np.zeros(c.n)
        for n in range(at_most + 1):
            if n:
                left = seconds - total
                joined = np.where((mine >= 0)[:, None], (c.score + transition(mine)) / 2.0, c.score)
                best = _best(joined, c.there & (c.duration <= left[:, None]) & ~used)
                pick = np.where(left > 5.0, best, -1)
            got = pick >= 0
            at = (all_, np.maximum(pick, 0))
            total = total + np.where(got, c.duration[at], 0.0)
            used |= got[:, None] & (c.item_id == c.item_id[at][:, None])
            mine, last = np.where(got, pick, mine), np.where(got, pick, last)
            out.append(pick)
    return np.stack(out, axis=1)


def _drawn(tag: str, *parts: np.ndarray) -> np.ndarray:
    """As `md5_unit` of the tag and the parts, joined by colons."""
    words = (f"{tag}:{':'.join(map(str, x))}".encode() for x in zip(*(p.tolist() for p in parts)))
    return np.fromiter((int.from_bytes(hashlib.md5(w).digest()[:4], "big") for w in words), dtype=np.float64, count=len(parts[0])) / 2.0**32


def usage_balanced_places(c: Lists, key: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """As `usage_balanced`; numbers are drawn only for the candidates that a step rates."""
    width = c.there.shape[1]
    same_kind = (c.kind[:, :, None] == c.kind[:, None, :]) & c.there[:, None, :]
    heads = c.there & ~(same_kind & np.tri(width, k=-1, dtype=bool)).any(axis=2)
    n_types, ordinal = heads.sum(axis=1), np.argsort(~heads, axis=1, kind="stable")
    uses, picked = np.zeros(c.there.shape, dtype=np.int64), np.full((c.n, int(steps.max(initial=0))), -1)
    for i in range(picked.shape[1]):
        rows = np.flatnonzero((i < steps) & (n_types > 0))
        own, at = key[rows], np.full(len(rows), i)
        turn = i % n_types[rows]
        broken = np.flatnonzero(_drawn(f"{seed}:r", own, at) < 0.3)
        turn[broken] = np.floor(_drawn(f"{seed}:t", own[broken], at[broken]) * n_types[rows[broken]])
        free, items = c.there[rows], c.item_id[rows]
        for back in (1, 2):
            if i >= back:
                free = free & (items != items[np.arange(len(rows)), picked[rows, i - back]][:, None])
        kind = c.kind[rows]
        same = free & (kind == kind[np.arange(len(rows)), ordinal[rows, turn]][:, None])
        pool = np.where(same.any(axis=1)[:, None], same, np.where(free.any(axis=1)[:, None], free, c.there[rows]))
        x, y = np.nonzero(pool)
        s = -c.score[rows[x], y] + _drawn(f"{seed}:n", own[x], at[x], items[x, y]) * 0.2 - 0.1
        n = uses[rows[x], y]
        by = np.lexsort((c.rank[rows[x], y], s, n, x))
        x, y, n = x[by], y[by], n[by]
        best = np.arange(len(x)) - np.searchsorted(x, x)
        pick = np.full(len(rows), -1)
        pick[x[best == 0]] = y[best == 0]
        coin = _drawn(f"{seed}:c", own, at) < 0.5
        few = (best < 3) & coin[x]
        x, y, n = x[few], y[few], n[few]
        g = -np.log(np.maximum(_drawn(f"{seed}:w", own[x], at[x], items[x, y]), 1e-12)) * (n + 1)
        by = np.lexsort((c.rank[rows[x], y], g, x))
        first = np.concatenate(([True], x[by][1:] != x[by][:-1])) if len(x) else np.zeros(0, dtype=bool)
        pick[x[by][first]] = y[by][first]
        picked[rows, i] = pick
        uses[rows] += items == items[np.arange(len(rows)), pick][:, None]
    return picked


def per_step_rows(df: DataFrame, key: str, steps: int, diversity: float, keep: int) -> DataFrame:
    """The lists of `per_step_lists` as rows (key, step, place, item_id, score)."""
    names = [key, "step", "place", "item_id", "score"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                c = Lists(part.column(1), ["item_id", "rank", "score"], [])
                if not c.there.any():
                    continue
                ids, used = part.column(0).to_numpy(), np.zeros(c.there.shape, dtype=bool)
                for step in range(steps):
                    score = _round(np.where(used, c.score * (1.0 - diversity), c.score))
                    kept = c.there & ((c.rank <= keep) | ~used)
                    order = np.argsort(np.where(kept, -score, np.inf), axis=1, kind="stable")
                    x, y = np.nonzero(np.arange(order.shape[1])[None, :] < kept.sum(axis=1)[:, None])
                    place = order[x, y]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[x], pa.int64()), pa.array(np.full(len(x), step), pa.int32()), pa.array(y + 1, pa.int32()),
                        pa.array(c.item_id[x, place], pa.int64()), pa.array(score[x, place])], names=names)
                    used |= c.item_id == np.take_along_axis(c.item_id, order[:, :1], axis=1)

    return df.select(F.col(key).cast("long").alias(key), "cands").mapInArrow(run, f"{key} long, step int, place int, item_id long, score double")
