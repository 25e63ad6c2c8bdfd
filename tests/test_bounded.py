"""Threshold stopping, best k per group and exclusion against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import vocab
from cadenza.operators import bounded
from cadenza.operators.nearest import CategoricalBlend, MultiFactor, TempoBlend

SCORERS = {
    "multi": (MultiFactor(vocab.SCORE_WEIGHTS), ["tempo_lo", "tempo_hi", "energy_rank", "difficulty_rank"]),
    "tempo": (TempoBlend(8.0), ["tempo"]),
    "categorical": (CategoricalBlend(), ["energy_rank", "role_code", "difficulty_rank"]),
}


def side(rng, n, prefix):
    tempo = rng.integers(90, 130, n).astype(float)
    m = rng.normal(size=(n, 5))
    m[: n // 3] = m[0]  # a third of the rows are copies
    return pd.DataFrame({
        prefix: np.arange(n), "vec": list(m), "tempo": tempo, "tempo_lo": tempo - 5, "tempo_hi": tempo + 5,
        "energy_rank": rng.integers(1, 4, n).astype(float), "difficulty_rank": rng.integers(1, 4, n).astype(float),
        "role_code": rng.integers(1, 4, n), "kind": rng.integers(1, 4, n)})


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(12)
    left, right = side(rng, 60, "req"), side(rng, 500, "item")
    frames = [spark.createDataFrame(d).withColumn("vec", F.col("vec").cast("array<double>")) for d in (left, right)]
    return left, right, *frames


def brute(left, right, scorer, k, group=None, used=frozenset()):
    def unit(d):
        m = np.stack(d.vec)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    cols = lambda d: {c: d[c].to_numpy() for c in d if c != "vec"}
    cos = unit(left) @ unit(right).T
    if getattr(scorer, "of_reported", False):
        cos = bounded.rounded(cos)
    s = bounded.rounded(scorer(cos, cols(left), cols(right)))
    out = set()
    for i in range(len(left)):
        for g in [None] if group is None else right[group].unique():
            js = [j for j in range(len(right)) if np.isfinite(s[i, j]) and (i, j) not in used and (g is None or right[group][j] == g)]
            out |= {(i, j, rank + 1) for rank, j in enumerate(sorted(js, key=lambda j: (-s[i, j], j))[:k])}
    return out


@pytest.mark.parametrize("name", SCORERS)
@pytest.mark.parametrize("group", [None, "kind"])
def test_equals_loops(spark, sides, monkeypatch, name, group):
    """Small tiles and cells; excluded pairs repeat, name unknown ids, and leave some requests with hardly an item."""
    monkeypatch.setattr(bounded, "TILE_LEFT", 7)
    monkeypatch.setattr(bounded, "TILE_RIGHT", 23)
    left, right, lf, rf = sides
    scorer, classes = SCORERS[name]
    used = [(i, j) for i in range(60) for j in range(500) if (i * j + i) % 3 == 0] + [(5, j) for j in range(2, 500)] + [(5, 9), (999, 1), (1, 999)]
    exclude = spark.createDataFrame(used, "req long, item long")
    own = lf.drop("kind")
    got = bounded.bounded_topk(own, rf, "req", "item", 6, scorer, classes, (60, 500), group=group, exclude=exclude, cell_left=16, cell_right=90)
    assert {(r.req, r.item, r["rank"]) for r in got.collect()} == brute(left, right, scorer, 6, group, frozenset(used))


def test_empty_sides(spark, sides):
    _, _, lf, rf = sides
    scorer, classes = SCORERS["multi"]
    for a, c in ((lf.limit(0), rf), (lf, rf.limit(0))):
        assert bounded.bounded_topk(a.drop("kind"), c, "req", "item", 3, scorer, classes, (1, 1)).count() == 0


def test_pairs_are_left_out(spark):
    """What a search scores of all pairs: less of a larger table, and hardly any where the limits are close."""
    from cadenza.operators.nearest import _side
    from cadenza.plans import binding as b

    share = {}
    for sf in ("sf0.001", "sf0.1"):
        left, right, _ = b.scoring_sides(spark, f"/root/testdata/{sf}")
        lt, rt = left.where("req_id < 2000").toArrow(), right.toArrow()
        (lm, lc), (rm, rc) = _side(lt, "vec", True), _side(rt, "vec", True)
        for name in ("multi", "tempo"):
            *_, scored = bounded.best_of_cell(lm, lc, rm, rc, "item_id", 5, *SCORERS[name])
            share[name, sf] = scored / (len(lm) * len(rm))
    print(share)
    assert share["multi", "sf0.1"] < 0.9 * share["multi", "sf0.001"] and share["tempo", "sf0.1"] < 0.5


@pytest.mark.parametrize("name", SCORERS)
@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("excluding", [False, True])
def test_classes_equal_loops(spark, sides, monkeypatch, tmp_path, name, group, excluding):
    """Few different vectors and attributes: classes of many items, ties between classes, classes that a request excludes whole."""
    monkeypatch.setattr(bounded, "TILE_LEFT", 7)
    monkeypatch.setattr(bounded, "TILE_RIGHT", 23)
    left, _, lf, _ = sides
    rng = np.random.default_rng(3)
    right = side(rng, 400, "item")
    right["own"] = right.item % 9
    right["vec"] = [right.vec[200 + i % 9] for i in range(400)]
    for c, n in (("tempo", 3), ("energy_rank", 2), ("difficulty_rank", 1), ("role_code", 2)):
        right[c] = (right.item % n * 7 + 100 if c == "tempo" else right.item % n + 1).astype(right[c].dtype)
    right["tempo_lo"], right["tempo_hi"] = right.tempo - 5, right.tempo + 5
    scorer, classes = SCORERS[name]
    used = [(i, j) for i in range(60) for j in range(400) if (i * j + i) % 3 == 0 or (i % 4 == 1 and j % 36 < 20)] + [(999, 1), (1, 999)] if excluding else []
    rows = spark.createDataFrame(right.drop(columns="vec"))
    vecs = spark.createDataFrame([(i, [float(x) for x in right.vec[i]]) for i in range(9)], "own long, vec array<double>")
    exclude = spark.createDataFrame(used, "req long, item long") if excluding else None
    got = bounded.classed_topk(lf.drop("kind"), rows, "req", "item", 6, scorer, classes, 60, ["own"], lambda df: df.join(vecs, "own"),
                               group=group, exclude=exclude, cell_left=16, cell_right=10)
    assert {(r.req, r.item, r["rank"]) for r in got.collect()} == brute(left, right, scorer, 6, group, frozenset(used))


def test_copies_add_no_work(spark, monkeypatch):
    """Twenty copies of every item make no more classes."""
    from cadenza.plans import binding as b
    from cadenza.plans import scoring

    sizes, real, plain = [], bounded._candidates, b.item_keys
    monkeypatch.setattr(bounded, "_candidates", lambda *a, **k: sizes.append(a[7][1]) or real(*a, **k))
    for times in (1, 20):
        monkeypatch.setattr(b, "item_keys", lambda *a: plain(*a).withColumn("item_id", F.explode(F.sequence("item_id", F.col("item_id") + (times - 1) * 10000, F.lit(10000)))))
        assert scoring.best_items(spark, "/root/testdata/sf0.001", 5).count() == 150 * 5
    assert sizes[0] == sizes[1]
