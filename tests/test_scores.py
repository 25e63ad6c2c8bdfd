"""Golden values of the score tables and labels."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import labels, scores, vectors
from cadenza.operators import experiments as ex


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [(120, 1.0), (130, 0.5), (140, math.exp(-0.25)), (112, 0.7), (135, 0.0)])
def test_interval(spark, value, want):
    got = one(spark, scores.interval_compat(F.lit(float(value)), F.lit(115.0), F.lit(125.0), 10.0))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("a,b,energy,difficulty", [("low", "low", 1.0, 1.0), ("low", "medium", 0.7, 0.8), ("low", "high", 0.3, 0.4)])
def test_ladders(spark, a, b, energy, difficulty):
    assert one(spark, scores.ladder(F.lit(a), F.lit(b))) == energy
    assert one(spark, scores.ladder(F.lit(a), F.lit(b), near=0.8, far=0.4)) == difficulty


@pytest.mark.parametrize("label,kind", [
    ("basic_step_1", "basic"), ("lady_right_turn_1", "turn"), ("cross_body_lead_1", "cross_body"), ("arm_styling_1", "styling"),
    ("body_roll_1", "body_roll"), ("dip_1", "dip"), ("shadow_position_1", "shadow"), ("hammerlock_1", "hammerlock"), ("unknown_move", "other")])
def test_types(spark, label, kind):
    assert one(spark, labels.type_of(F.lit(label))) == kind


def test_category_rules_in_order(spark):
    assert one(spark, labels.category_of(F.lit("double_cross_body_lead"))) == "cross_body_lead"
    assert one(spark, labels.category_of(F.lit("combination_basic_step"))) == "basic_step"
    assert one(spark, labels.category_of(F.lit("waltz"))) is None


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4)])
    assert one(spark, vectors.l2_normalize(v)) == [0.6, 0.8]
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(v, zero)) == 0.0
    assert one(spark, vectors.pad_to(v, 4)) == [3.0, 4.0, 0.0, 0.0]
    odd = F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(2.0))
    assert one(spark, vectors.clean(odd)) == [0.0, 1.0, -1.0, 2.0]


def test_grid():
    assert len(ex.grid_ids()) == 100
    assert len(ex.grid_ids(steps=3)) == 81
    assert ex.grid_ids() == ex.grid_ids()


def test_grid_weights_sum_to_one(spark):
    w = ex.grid_weights(F.lit(317))
    assert one(spark, sum(w.values())) == pytest.approx(1.0)
