"""Sequence folds against plain Python, and invariants of the pose and song vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadenza.operators import clip_features, folds
from cadenza.plans import sequences

SF = "/root/testdata/sf0.001"
E, D = ["low", "medium", "high"], ["beginner", "intermediate", "advanced"]


def compatible(a, b):
    if abs(E.index(a.energy) - E.index(b.energy)) <= 1 or abs(D.index(a.difficulty) - D.index(b.difficulty)) <= 1:
        return True
    if a.label == "basic_step":
        return True
    if a.label in ("cross_body_lead", "double_cross_body_lead") or "turn" in a.label:
        return "turn" in b.label or b.label == "basic_step"
    return False


def greedy(cands, steps, div, weight):
    picked = [next((c for c in cands if "basic" in c.label and c.rank <= 20), cands[0])]
    for i in range(1, steps):
        best = None
        for c in cands:
            s = c.score
            if compatible(picked[-1], c) and c.item_id != picked[-1].item_id:
                s += weight * 0.3
            if any(p.item_id == c.item_id for p in picked):
                s *= 1 - div
            if i > 1 and c.label not in [p.label for p in picked[-2:]]:
                s += div * 0.2
            key = (round(s, 9), -c.rank)
            if best is None or key > best[0]:
                best = (key, c)
        picked.append(best[1])
    return [p.item_id for p in picked]


def test_transition_greedy(spark):
    base = sequences.lists(spark, SF)
    rows = base.withColumn("picked", folds.transition_greedy(F.col("cands"), "kind", 8, F.lit(0.3), F.lit(0.4))).collect()
    assert rows
    for r in rows:
        assert [p.item_id for p in r.picked] == greedy(r.cands, 8, 0.3, 0.4)


def test_section_greedy_keeps_to_time(spark):
    got = entry.queries()["seq2_section_greedy"](spark, SF).toPandas()
    per = got.groupby("req_id").agg(total=("duration", "sum"), target=("target", "first"))
    assert (per.total <= per.target).all() and len(per) > 0


def test_usage_balanced_never_repeats_last_two(spark):
    got = entry.queries()["top15_usage_balanced_pick"](spark, SF).toPandas().sort_values(["req_id", "pos"])
    for _, g in got.groupby("req_id"):
        ids = list(g.item_id)
        assert len(ids) == max(8, (30 + g.req_id.iloc[0] % 200) // 8)
        assert all(ids[i] not in ids[max(0, i - 2):i] for i in range(1, len(ids)))


def test_sequences_have_all_requests(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    out = entry.queries()["seq5_end_to_end"](spark, SF)
    assert out.count() == n
    full = entry.queries()["seq4_complete_sequence"](spark, SF).toPandas()
    assert len(full) == n and full.transition_quality.between(0, 1).all()


def test_clip_vectors(spark):
    got = entry.queries()["win22_clip_vectors"](spark, SF).toPandas()
    assert (got.pose_dim == 384).all() and (got.move_dim == 26).all() and (got.pose_tail == 0).all()
    assert np.isfinite(got.pose_norm).all()


@pytest.mark.parametrize("name", ["win23_song_vector", "win24_fusion_song_vector"])
def test_song_vectors(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert (got.dim == 128).all() and np.allclose(got.length, 1.0)


def test_feature_row(spark):
    got = entry.queries()["prj39_movement_feature_row"](spark, SF).toPandas()
    assert got.shape[1] == 33 + 2
    assert got.movement_complexity_score.between(0, 1).all() and (got.min_tempo_compatibility < got.max_tempo_compatibility).all()


def test_hull():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [2, 0]], float)
    assert clip_features._hull_area(square) == pytest.approx(4.0)
    assert clip_features._hull_area(square[:2]) == 0.0
    area = entry.queries()["win21_area_and_range"]
    assert callable(area)
