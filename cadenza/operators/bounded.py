"""Exact best-k search by threshold stopping, with a best-k state per group and an exclusion set.

A score that is a multiple of the cosine plus a function of a few attributes has the same second part for all items of a
class, items with equal attributes; it is worked out once for a request and class. With a cosine of one it is an upper bound.
A cell visits the item classes in the order of their bound and stops for a request once no class left can reach its k-th
best score so far; of the others only the cosine is computed for each item. The state of a request is its k best per group; it is
kept inside the cell and merged between cells. Pairs of an exclusion set are left out before the ranking. Work inside a
cell goes by tiles, so cells may be large and rows are copied to few of them.

`classed_topk` searches classes of right rows with equal vectors and attributes in place of the rows: the work then follows the
number of different rows, and only the rows of the best classes are listed. Where many left rows share a vector, the cosines of a vector
are worked out and sorted once for all of its rows (`best_of_shared`); a left row then reads only the entries above a lower bound of its
k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .nearest import DIGITS, Scorer, _side

#: Left rows and right rows of one tile, and of one cell.
TILE_LEFT, TILE_RIGHT = 64, 1024
CELL_LEFT, CELL_RIGHT = 1 << 14, 1 << 16
#: Left rows of a cell where rows share vectors and hold none, vectors of one product, and scores of one tile.
CELL_SHARED, VECTORS, TILE_SCORES = 1 << 16, 16, 1 << 19
#: Below every score; pairs of -inf never count.
LEAST = -1e300


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS places, halves up."""
    return np.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def _by_class(rc: dict, classes: list[str], then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right rows in order of their class, and inside it of `then`, and where each class starts and ends."""
    n = len(then)
    keys = np.stack([rc[c].astype(np.float64) for c in classes]) if classes else np.zeros((1, n))
    order = np.lexsort((then, *keys[::-1]))
    keys = keys[:, order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if n else np.zeros(0, dtype=np.int64)
    return order, starts, np.concatenate((starts[1:], [n]))


def best_of_cell(lm, lc: dict, rm, rc: dict, right_id: str, k: int, scorer: Scorer, classes: list[str], used=None, more=None):
    """(left rows, right ids, scores) of the k best right rows of each left row, and how many pairs were scored.

    `classes` names the right columns that the score reads. `used` holds (left rows, right rows) of excluded pairs. Ties go
    to the smaller id. Scores of -inf never count. `more` is a number of rows for each left row that may follow the k best if they
    share the score of the last one.
    """
    n_left, n_right = len(lm), len(rm)
    order, starts, ends = _by_class(rc, classes, np.arange(n_right))
    rep, rm = {c: rc[c][order][starts] for c in classes}, rm[order]
    shared = [c for c in classes if c in lc]
    by_left = np.lexsort([lc[c] for c in shared[::-1]]) if shared else np.arange(n_left)
    banned = np.zeros((0, 2), dtype=np.int64)
    if used is not None and len(used[0]):
        banned = np.stack(used, axis=1)
        banned = banned[np.argsort(banned[:, 0], kind="stable")]
    out_row, out_id, out_score, scored = [], [], [], 0
    for at in range(0, n_left, TILE_LEFT):
        mine = by_left[at: at + TILE_LEFT]
        left = {c: v[mine] for c, v in lc.items()}
        base = scorer(np.zeros((len(mine), len(starts))), left, rep)
        top = base + scorer.slope + 10.0 ** -DIGITS
        visit = np.argsort(-top.max(axis=0), kind="stable")
        rest = np.maximum.accumulate(top[:, visit][:, ::-1], axis=1)[:, ::-1]  # highest bound of the classes not yet visited
        filled = np.cumsum((ends - starts)[visit])
        best = np.full((len(mine), k), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        mask = None
        if len(banned):
            mask = np.zeros((len(mine), n_right), dtype=bool)
            for x, row in enumerate(mine):
                lo, hi = np.searchsorted(banned[:, 0], [row, row + 1])
                mask[x, banned[lo:hi, 1]] = True
        i = 0
        while i < len(visit):
            open_ = np.flatnonzero((rest[:, i] >= best[:, 0]) & np.isfinite(rest[:, i]))
            if not len(open_):
                break
            j = int(np.searchsorted(filled, (filled[i - 1] if i else 0) + TILE_RIGHT)) + 1
            own = visit[i:j]
            i = j
            slots = np.concatenate([np.arange(starts[c], ends[c]) for c in own])
            kind = np.repeat(own, (ends - starts)[own])
            for lo in range(0, len(slots), 8 * TILE_RIGHT):
                part = slots[lo: lo + 8 * TILE_RIGHT]
                s = lm[mine[open_]] @ rm[part].T
                if getattr(scorer, "of_reported", False):  # a blend of the similarity as a search reports it
                    s = rounded(s)
                s *= scorer.slope
                s += base[np.ix_(open_, kind[lo: lo + 8 * TILE_RIGHT])]
                scored += s.size
                if mask is not None:
                    s[mask[np.ix_(open_, order[part])]] = -np.inf
                x, y = np.nonzero(s >= np.maximum(best[open_, :1] - 10.0 ** -DIGITS, LEAST))
                if not len(x):
                    continue
                value = rounded(s[x, y])
                held.append((open_[x], rc[right_id][order[part[y]]], value))
                hit = np.unique(x)
                both = np.concatenate((best[open_[hit]], rounded(s[hit])), axis=1)
                best[open_[hit]] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        if held:
            row, ids, s = (np.concatenate(x) for x in zip(*held))
            keep = s >= best[row, 0]
            row, ids, s = row[keep], ids[keep], s[keep]
            by = np.lexsort((ids, -s, row))
            row, ids, s = row[by], ids[by], s[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < (k if more is None else k + more[mine[row]])
            out_row.append(mine[row[keep]])
            out_id.append(ids[keep])
            out_score.append(s[keep])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    return cat(out_row, np.int64), cat(out_id, np.int64), cat(out_score, np.float64), scored


def best_of_shared(lm, of, lc: dict, rm, rc: dict, right_id: str, k: int, scorer: Scorer, classes: list[str], used=None, more=None):
    """As `best_of_cell`, for left rows that share vectors: row i has the vector lm[of[i]].

    The right rows are sorted once for each vector, by class and cosine. A score grows with the cosine inside a class, so that the
    q-th highest of the scores which the n-th right row of each class reaches has q * n rows at or above it: a lower bound of what can
    be among the best. Only entries from this bound on are read, found by their place in the sorted classes.
    """
    n_right, slack = len(rm), 2 * 10.0 ** -DIGITS
    order, starts, ends = _by_class(rc, classes, rc[right_id])
    rep, ids, rm = {c: rc[c][order][starts] for c in classes}, rc[right_id][order], rm[order]
    kind = np.repeat(np.arange(len(starts)), ends - starts)
    kind = kind.astype(np.uint16) if len(starts) < 1 << 16 else kind
    slot = np.empty(n_right, dtype=np.int64)
    slot[order] = np.arange(n_right)
    banned = np.zeros(0, dtype=np.int64) if used is None else np.unique(used[0] * n_right + slot[used[1]])
    gone = np.bincount(banned // max(n_right, 1), minlength=len(of))
    need = k + gone + (0 if more is None else more)
    by_vec = np.lexsort((need, of))
    first = np.searchsorted(of[by_vec], np.arange(len(lm) + 1))
    out_row, out_id, out_score, scored = [], [], [], 0
    for at in range(0, len(lm) if n_right else 0, VECTORS):
        cosines = lm[at: at + VECTORS] @ rm.T if scorer.slope else np.zeros((len(lm[at: at + VECTORS]), n_right))
        # Equal vectors have equal cosines, whatever the order of the summation.
        cosines = rounded(cosines) if getattr(scorer, "of_reported", False) else np.round(cosines, 14)
        for u, cos in enumerate(cosines, at):
            rows = by_vec[first[u]: first[u + 1]]
            if not len(rows):
                continue
            scored += n_right
            by = np.argsort(-cos, kind="stable")
            by = by[np.argsort(kind[by], kind="stable")]
            c, g = cos[by], kind[by].astype(np.int64)
            turn = np.concatenate(([True], (c[1:] != c[:-1]) | (g[1:] != g[:-1])))
            place = np.arange(n_right) - np.maximum.accumulate(np.where(turn, np.arange(n_right), 0))
            few = place < need[rows].max()  # of equal rows only the first can be among the best
            by, c, g = by[few], c[few], g[few]
            begin = np.searchsorted(g, np.arange(len(starts) + 1))
            key = 4.0 * g - c
            step = max(1, TILE_SCORES // max(1, len(starts)))
            for lo in range(0, len(rows), step):
                mine = rows[lo: lo + step]
                base = scorer(np.zeros((len(mine), len(starts))), {n: v[mine] for n, v in lc.items()}, rep)
                deep, bound, n = int(need[mine].max()), np.full(len(mine), LEAST), 1
                while True:
                    q = -(-deep // n)
                    there = np.flatnonzero(begin[1:] - begin[:-1] >= n)
                    if len(there) >= q:
                        nth = base[:, there] + scorer.slope * c[begin[there] + n - 1]
                        bound = np.maximum(bound, np.partition(nth, len(there) - q, axis=1)[:, len(there) - q])
                    if q == 1:
                        break
                    n *= 2
                bound -= slack
                x, y = np.nonzero(np.isfinite(base) & (base + scorer.slope * c[begin[:-1]] >= bound[:, None]))
                least = np.maximum((bound[x] - base[x, y]) / scorer.slope - slack, -1.5) if scorer.slope else np.full(len(x), -1.5)
                end = np.searchsorted(key, 4.0 * y - least, side="right")
                n_each = np.maximum(end - begin[y], 0)
                x, y = np.repeat(x, n_each), np.repeat(y, n_each)
                entry = np.arange(len(x)) - np.repeat(np.cumsum(n_each) - n_each, n_each) + begin[y]
                if len(banned):
                    own = mine[x] * n_right + by[entry]
                    ok = banned[np.minimum(np.searchsorted(banned, own), len(banned) - 1)] != own
                    x, y, entry = x[ok], y[ok], entry[ok]
                s = rounded(base[x, y] + scorer.slope * c[entry])
                found = ids[by[entry]]
                sort = np.lexsort((found, -s, x))
                x, s, found = x[sort], s[sort], found[sort]
                head = np.searchsorted(x, x)
                rank = np.arange(len(x)) - head
                keep = rank < k
                if more is not None and len(x):
                    last = np.minimum(head + k - 1, len(x) - 1)
                    keep |= (rank < k + more[mine[x]]) & (s == s[last])
                out_row.append(mine[x[keep]])
                out_id.append(found[keep])
                out_score.append(s[keep])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    return cat(out_row, np.int64), cat(out_id, np.int64), cat(out_score, np.float64), scored


def _blocks(df: DataFrame, n: int, rows: int, others: int = 1) -> int:
    """Enough blocks to keep cells bounded, and for a small table enough to use the cluster, with so many blocks on the other side."""
    return max(1, math.ceil(n / rows), min(math.ceil(df.sparkSession.sparkContext.defaultParallelism / others), math.ceil(n / 512)))


def _needed(row: np.ndarray, score: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Mask of the entries that fewer than k rows of higher scores stand before; entries are in order of row and score and stand for n rows."""
    if not len(row):
        return np.zeros(0, dtype=bool)
    at = np.arange(len(row))
    turn = np.concatenate(([True], row[1:] != row[:-1]))
    step = turn | np.concatenate(([True], score[1:] != score[:-1]))
    first, tie = np.maximum.accumulate(np.where(turn, at, 0)), np.maximum.accumulate(np.where(step, at, 0))
    before = np.cumsum(n) - n
    return before[tie] - before[first] < k


def bounded_topk(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, scorer: Scorer, classes: list[str],
    sizes: tuple[int, int], vec: str = "vec", group: str | None = None, exclude: DataFrame | None = None,
    cell_left: int = CELL_LEFT, cell_right: int = CELL_RIGHT, unit: bool = True,
) -> DataFrame:
    """(left_id, right_id, score, rank): the k best right rows of each left row, or of each left row and `group`.

    `classes` names the numeric columns of `right` that the scorer reads; its score is `scorer.slope` times the cosine plus a
    function of these, and the slope is not negative. `group` is an integer column of `right`, returned with the result, and ranks then count inside it.
    `exclude` holds pairs (left_id, right_id) that never count; repeated pairs, and pairs of unknown ids, do no harm.
    Exact; ties at the ninth digit go to the smaller right id.
    """
    best = _candidates(left, right, left_id, right_id, k, scorer, classes, sizes, vec, group, exclude, cell_left, cell_right, unit)
    return _ranked(best, left_id, right_id, k, group)


def _ranked(best: DataFrame, left_id: str, right_id: str, k: int, group: str | None) -> DataFrame:
    w = Window.partitionBy(left_id, *([group] if group else [])).orderBy(F.desc("score"), F.asc(right_id))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _candidates(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, scorer: Scorer, classes: list[str], sizes: tuple[int, int],
    vec: str | None, group: str | None, exclude: DataFrame | None, cell_left: int, cell_right: int, unit: bool,
    stands_for: str | None = None, more: str | None = None, own: str | None = None, with_vec: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(left_id, right_id, score and group): what each cell keeps.

    A right row stands for `stands_for` rows at least; what k rows of higher scores stand before is left out. `more` is a column of
    `left`, see `best_of_cell`. With `own`, an integer column of `left`, rows of one value share the vector that `with_vec` adds to it:
    they lie together, in parts of `cell_left` rows, and the vector goes to each part once.
    """
    n_left, n_right = sizes
    nr = max(1, math.ceil(n_right / cell_right))
    nl = _blocks(left, n_left, cell_left, nr)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    home = block(left_id, nl)
    if own is not None:
        parts = F.ceil(F.count(F.lit(1)) / F.lit(cell_left)).cast("int")
        heads = with_vec(left.groupBy(own).agg(parts.alias("_parts")))
        home = F.pmod(F.xxhash64(own, "_part"), F.lit(nl)).cast("int")
        left = left.join(heads.select(own, "_parts"), own).withColumn("_part", F.pmod(F.xxhash64(left_id), F.col("_parts")).cast("int"))
        left = left.withColumn("_home", home).drop("_parts", "_part")
        home = F.col("_home")
    a = left.withColumn("_used", F.lit(None).cast("long")).withColumn("_lb", home).withColumn("_rb", every(nr)).drop("_home")
    if exclude is not None:  # a pair goes to the one cell of its two ids
        pairs = exclude.select(F.col(left_id).cast("long").alias(left_id), F.col(right_id).cast("long").alias("_used")).distinct()
        if own is not None:
            pairs = pairs.join(left.select(left_id, "_home").hint("merge"), left_id)
        gaps = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (left_id, "_home")]
        a = a.unionByName(pairs.select(left_id, "_used", home.alias("_lb"), block("_used", nr).alias("_rb"), *gaps))
    if own is not None:
        every_part = heads.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        of_parts = every_part.select(own, "vec", F.pmod(F.xxhash64(own, "_part"), F.lit(nl)).cast("int").alias("_lb")).distinct().withColumn("_rb", every(nr))
        a = a.unionByName(of_parts, allowMissingColumns=True)
    b = right.withColumn("_rb", block(right_id, nr)).withColumn("_lb", every(nl))
    names = [left_id, right_id, "score", *([group] if group else [])]

    def cell(lt: pa.Table, rt: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        heads = None
        if own is not None and lt.num_rows:
            is_head = ~lt.column(left_id).is_valid().to_numpy(zero_copy_only=False)
            heads, lt = lt.filter(pa.array(is_head)), lt.filter(pa.array(~is_head)).drop_columns(["vec"])
        is_pair = lt.column("_used").is_valid().to_numpy(zero_copy_only=False) if lt.num_rows else np.zeros(0, dtype=bool)
        pairs, lt = lt.filter(pa.array(is_pair)), lt.filter(pa.array(~is_pair)).drop_columns(["_used"])
        if lt.num_rows and rt.num_rows:
            lm, lc = _side(lt, vec if heads is None else None, unit)
            if heads is not None:
                hm, hc = _side(heads.select([own, "vec"]), "vec", unit)
                by = np.argsort(hc[own])
                hm, of = hm[by], np.searchsorted(hc[own][by], lc[own])
            rm, rc = _side(rt, vec, unit)
            places = [np.arange(rt.num_rows)] if group is None else [np.flatnonzero(rc[group] == g) for g in np.unique(rc[group])]
            one, other = pairs.column(left_id).to_numpy(), pairs.column("_used").to_numpy()
            by_id = np.argsort(lc[left_id])
            row = by_id[np.minimum(np.searchsorted(lc[left_id][by_id], one), lt.num_rows - 1)]
            row_ok = lc[left_id][row] == one
            for place in places:
                part = {c: v[place] for c, v in rc.items()}
                by = np.argsort(part[right_id])
                col = by[np.minimum(np.searchsorted(part[right_id][by], other), len(place) - 1)]
                ok = row_ok & (part[right_id][col] == other)
                rest = (lc, rm[place], part, right_id, k, scorer, classes, (row[ok], col[ok]), None if more is None else lc[more])
                r, i, s, _ = best_of_cell(lm, *rest) if heads is None else best_of_shared(hm, of, *rest)
                if stands_for is not None:
                    few = _needed(r, s, part[stands_for][by][np.searchsorted(part[right_id][by], i)], k)
                    r, i, s = r[few], i[few], s[few]
                rows.append((lc[left_id][r], i, s, np.full(len(r), part[group][0] if group else 0)))
        cols = [np.concatenate(x) for x in zip(*rows)] if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, cols, kinds)})

    schema = f"{left_id} long, {right_id} long, score double" + (f", {group} long" if group else "")
    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInArrow(cell, schema)


def classed_topk(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, scorer: Scorer, classes: list[str], n_left: int,
    by: list[str], with_vec: Callable[[DataFrame], DataFrame], group: str | None = None, exclude: DataFrame | None = None,
    cell_left: int | None = None, cell_right: int = CELL_RIGHT, unit: bool = True, own: str | None = None,
) -> DataFrame:
    """As `bounded_topk`, for a right side with many rows of equal vectors and attributes.

    `by` names the columns of `right` that fix the vector of a row, and `with_vec` adds it, as `vec`, to rows of these columns, as well
    as those of `classes` that `right` lacks; a score without a slope needs no `vec`. Rows that agree on `by`, `classes` and `group` are one class, named by its smallest id. The k best rows are in the k best classes by
    score and smallest id; of a class its k smallest ids can be among them. With `exclude`, a class is left out for a left row that
    excludes all of its rows, and lists are longer by the most rows of a class that one left row excludes. `own` names an integer column
    of `left` to which `with_vec` adds the vector; `left` then holds no vectors, and rows that share one are searched together.
    """
    cell_left = cell_left or (CELL_LEFT if own is None else CELL_SHARED)
    extra = [group] if group else []
    vec = "vec" if scorer.slope else None
    same = list(dict.fromkeys([*by, *[c for c in classes if c in right.columns], *extra]))
    rows = right.select(right_id, *same)
    depth, gone, hidden = k, None, None
    if exclude is not None:
        reps = rows.groupBy(*same).agg(F.min(right_id).alias("_rep"), F.count(F.lit(1)).alias("_size")).select(F.col("_rep"), "_size", *[F.col(c).alias(f"_s_{c}") for c in same])
        agree = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in same]
        gone = exclude.select(F.col(left_id).cast("long").alias(left_id), F.col(right_id).cast("long").alias(right_id)).distinct()
        of_class = rows.join(reps.hint("merge"), agree).select(right_id, "_rep", "_size")
        hidden = written(gone.join(of_class.hint("merge"), right_id).groupBy(left_id, "_rep", "_size").agg(F.count(F.lit(1)).alias("_gone")), "hidden")
        depth = k + (hidden.agg(F.max("_gone")).first()[0] or 0)
    place = Window.partitionBy(*same).orderBy(right_id)
    few = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= depth)
    # At most `depth` ids in a list.
    table = written(few.groupBy(*same).agg(F.array_sort(F.collect_list(right_id)).alias("_ids")).withColumn("_rep", F.col("_ids")[0]), "classes")
    reps = with_vec(table.select(F.col("_rep").alias(right_id), *same, F.greatest(F.size("_ids") - (depth - k), F.lit(0)).cast("long").alias("_n")))
    reps = reps.select(right_id, "_n", *dict.fromkeys([*classes, *extra, *([vec] if vec else [])]))
    asked, away, more = left, None, None
    if exclude is not None:
        some = hidden.where("_gone < _size").groupBy(left_id).agg(F.count(F.lit(1)).alias("_more"))
        asked, more = left.join(some.hint("merge"), left_id, "left").fillna(0, ["_more"]), "_more"
        away = hidden.where("_gone = _size").select(left_id, F.col("_rep").alias(right_id))
    n = table.count()
    best = _candidates(asked, reps, left_id, right_id, k, scorer, classes, (n_left, n), vec, group, away, cell_left, cell_right, unit, "_n", more, own, with_vec)
    if exclude is None and n > cell_right:  # cells are merged before rows are listed
        best = _ranked(best, left_id, right_id, k, group).drop("rank")
    listed = best.withColumnRenamed(right_id, "_rep").join(table.select("_rep", "_ids"), "_rep").select(
        left_id, F.explode("_ids").alias(right_id), "score", *extra)
    if gone is not None:
        listed = listed.join(gone, [left_id, right_id], "left_anti")
    return _ranked(listed, left_id, right_id, k, group)
