"""Songs cut into many small units give the results of whole songs; hulls of hulls."""

import numpy as np
import pytest

import __spark_entry__ as entry
from cadenza.operators import clip_features as cf
from cadenza.operators import series
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "win1_velocity_coverage_direction", "win2_moving_average", "win3_interval_regularity", "win4_measure_pattern", "win5_alternation",
    "win6_transition_points", "win7_peak_density", "win8_intensity_profile", "win9_regional_displacement", "win10_autocorrelation_peak",
    "win11_spectral_concentration", "win12_path_descriptors", "win15_equal_parts", "win21_area_and_range",
]


@pytest.mark.parametrize("name", NAMES)
def test_small_units(spark, monkeypatch, name):
    monkeypatch.setattr(series, "UNIT", 8)
    monkeypatch.setattr(cf, "HULL_FRAMES", 8)
    monkeypatch.setattr(cf, "HULL_FAN", 2)
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


def test_hull_of_many_points():
    """The quick test of the extremes leaves out no corner; copies and lines give what they should."""
    rng = np.random.default_rng(1)
    for n in (3, 9, 40, 500):
        for points in (rng.normal(size=(n, 2)), rng.integers(0, 4, (n, 2)).astype(float), np.column_stack([np.arange(n), 2.0 * np.arange(n)])):
            ring = cf._ring(points)
            step = np.roll(ring, -1, axis=0) - ring
            if len(ring) > 2:
                side = step[:, :1] * (points[:, 1][None, :] - ring[:, 1:]) - step[:, 1:] * (points[:, 0][None, :] - ring[:, :1])
                assert (side >= -1e-9).all()
            else:
                assert cf._hull_area(points) == 0.0
    grid = np.array([[x, y] for x in range(5) for y in range(7)], dtype=float)
    assert cf._hull_area(np.repeat(grid, 3, axis=0)) == pytest.approx(24.0)
