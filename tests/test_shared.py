"""Searches of left rows that share vectors against plain loops, and the greedy folds on arrays against the column forms."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import bounded, folds, nearest
from cadenza.plans import sequences
from tests.test_bounded import SCORERS, brute, side

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SCORERS)
@pytest.mark.parametrize("banning", [False, True])
def test_equals_the_cell_search(monkeypatch, name, banning):
    """Copies of vectors, ties, exclusions, longer lists, and tiles of a few rows: the same rows as the search row by row."""
    monkeypatch.setattr(bounded, "TILE_SCORES", 60)
    monkeypatch.setattr(bounded, "VECTORS", 3)
    rng = np.random.default_rng(5)
    left, right = side(rng, 90, "req"), side(rng, 300, "item")
    vecs = np.stack(left.vec)[25:36]
    of = rng.integers(0, len(vecs), 90)
    of[of == 4] = 5  # a vector without rows
    scorer, classes = SCORERS[name]
    lc, rc = ({c: d[c].to_numpy() for c in d if c != "vec"} for d in (left, right))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    lm, rm = unit(vecs), unit(np.stack(right.vec))
    used = tuple(np.array([(i, j) for i in range(90) for j in range(300) if (i * j + i) % 3 == 0 or i == 7]).T) if banning else None
    more = rng.integers(0, 9, 90) if banning else None
    rest = (lc, rm, rc, "item", 6, scorer, classes, used, more)
    want, got = bounded.best_of_cell(lm[of], *rest), bounded.best_of_shared(lm, of, *rest)
    assert set(zip(*(x.tolist() for x in got[:3]))) == set(zip(*(x.tolist() for x in want[:3]))) and len(got[0]) == len(want[0]) > 0


@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("excluding", [False, True])
def test_shared_classes_equal_loops(spark, group, excluding):
    """Cells of a few rows: a vector with many requests is split, requests of an unknown vector are left out."""
    rng = np.random.default_rng(8)
    left, right = side(rng, 80, "req"), side(rng, 200, "item")
    base = np.stack(left.vec)[30:39]
    left["own"], right["own"] = np.where(np.arange(80) < 50, 2, np.arange(80) % 9), right.item % 9
    for d in (left, right):
        d["vec"] = [base[i] for i in d.own]
    scorer, classes = SCORERS["multi"]
    used = [(i, j) for i in range(80) for j in range(200) if (i * j + i) % 3 == 0 or (i % 4 == 1 and j % 36 < 20)] + [(999, 1), (1, 999)] if excluding else []
    vecs = spark.createDataFrame([(i, [float(x) for x in base[i]]) for i in range(9)], "own long, vec array<double>")
    rows = [spark.createDataFrame(d.drop(columns=["vec"])) for d in (left.drop(columns="kind"), right)]
    unknown = rows[0].limit(1).selectExpr("500L as req", "99L as own", "tempo", "tempo_lo", "tempo_hi", "energy_rank", "difficulty_rank", "role_code")
    asked = rows[0].select(unknown.columns).unionByName(unknown)
    exclude = spark.createDataFrame(used, "req long, item long") if excluding else None
    got = bounded.classed_topk(asked, rows[1], "req", "item", 6, scorer, classes, 81, ["own"], lambda df: df.join(vecs, "own"),
                               group=group, exclude=exclude, cell_left=16, cell_right=10, own="own")
    assert {(r.req, r.item, r["rank"]) for r in got.collect()} == brute(left, right, scorer, 6, group, frozenset(used))


def test_work_follows_vectors(spark, monkeypatch):
    """Ten copies of every request add no cosines."""
    rng = np.random.default_rng(2)
    right = side(rng, 400, "item")
    rc = {c: right[c].to_numpy() for c in right if c != "vec"}
    rm = np.stack(right.vec)
    work = []
    for times in (1, 10):
        left = side(rng, 20 * times, "req")
        lc = {c: left[c].to_numpy() for c in left if c != "vec"}
        work.append(bounded.best_of_shared(rm[200:220], np.arange(20 * times) % 20, lc, rm, rc, "item", 5, *SCORERS["multi"])[3])
    assert work[0] == work[1] == 20 * 400


@pytest.mark.parametrize("width", [1, 3, 30])
def test_folds_on_arrays(spark, width):
    """Short lists, a tile of all requests: the picks of the column forms."""
    base = sequences.lists(spark, SF).withColumn("cands", F.slice("cands", 1, F.when(F.col("req_id") % 5 == 0, 1).otherwise(width)))
    base = base.withColumns({"diversity": F.col("req_id") % 4 / 10.0, "sections": F.array(*[(20 + (F.col("req_id") * 3 + i * 7) % 31).cast("double") for i in range(3)])})
    base = base.unionByName(base.limit(1).withColumn("req_id", F.lit(-1).cast("long")).withColumn("cands", F.slice("cands", 1, 0))).localCheckpoint()
    names = ["item_id", "rank", "score", "duration"], ["label", "energy", "difficulty"]
    pairs = [
        (folds.transition_greedy(F.col("cands"), "kind", 8, F.col("diversity"), F.lit(0.4)), partial(folds.greedy_places, steps=8), {"diversity": F.col("diversity"), "weight": F.lit(0.4)}),
        (folds.section_greedy(F.col("cands"), F.col("sections")), folds.section_places, {"sections": F.col("sections")})]
    for column, fold, given in pairs:
        got = folds.with_picks(base, fold, *names, given)
        want = base.withColumn("want", column)
        rows = got.select("req_id", "picked").join(want.select("req_id", "want"), "req_id").collect()
        assert len(rows) == 151 and all(r.picked == r.want for r in rows)
    lists = folds.per_step_lists(F.col("cands"), 6, 0.3, 3)
    want = base.where("req_id >= 0").select("req_id", F.posexplode(lists).alias("step", "list")).select("req_id", "step", F.posexplode("list").alias("at", "p"))
    want = want.selectExpr("req_id", "step", "at + 1", "p.item_id", "-p.s")
    assert sorted(map(tuple, folds.per_step_rows(base, "req_id", 6, 0.3, 3).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("drawn", [1, 4096])
def test_pair_sample_by_hash_ranges(spark, monkeypatch, drawn):
    """drawn by ranges of the hash, or listed: the smallest hashes of all pairs, and no cell holds pairs of items."""
    monkeypatch.setattr(nearest, "DRAWN", drawn)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": rng.permutation(5000)[:300], "difficulty_rank": rng.integers(1, 4, 300).astype(float), "tempo": rng.integers(90, 130, 300).astype(float)})
    scorers = {"d": nearest.Ordinal("difficulty_rank"), "t": nearest.Gaussian("tempo")}
    i, j = np.nonzero(pdf.id.values[:, None] < pdf.id.values[None, :])
    h = nearest.pair_hash(pdf.id.values[i], pdf.id.values[j], 4)
    got = nearest.balanced_pair_sample(spark.createDataFrame(pdf), "id", scorers, 0.7, 0.3, 20, seed=4).toPandas()
    for name, fn in scorers.items():
        s = np.round(fn(None, {c: pdf[c].values for c in pdf}, {c: pdf[c].values for c in pdf})[i, j], 9)
        kinds = {"positive": s >= 0.7, "negative": s <= 0.3}
        for kind, m in kinds.items():
            want = sorted(zip(h[m], pdf.id.values[i[m]], pdf.id.values[j[m]]))[: min(20, *(int(x.sum()) for x in kinds.values()))]
            g = got[(got.name == name) & (got["class"] == kind)]
            assert len(want) == 20 and {(a, c) for _, a, c in want} == set(zip(g.a, g.b))


def test_index_batches_are_small(spark, monkeypatch):
    """a row that goes to many cells is copied in small batches, and a cell works by tiles."""
    most = []
    real = nearest._copies
    monkeypatch.setattr(nearest, "_copies", lambda order, last: [most.append(len(x[0])) or x for x in real(order, last)])
    order = np.tile(np.arange(200), (10_000, 1))
    parts = list(nearest._copies(order, np.full(10_000, 150)))
    assert max(most) <= nearest.COPIES + 200 and sum(most) == 10_000 * 150
    assert all((np.concatenate([x[k] for x in parts]) == w).all() for k, w in enumerate((np.repeat(np.arange(10_000), 150), np.tile(np.arange(150), 10_000))))
