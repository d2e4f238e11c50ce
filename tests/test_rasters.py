"""Resampling and comparison of rasters of unequal size."""

import numpy as np
import pytest

from loomspan.operators.rasters import compare_resized, resample, weights


def test_weights_of_a_halving_and_a_doubling():
    # By hand: at half the samples the kernel is twice as wide; the two middle samples lie 0.25 from the wanted one.
    near = np.sinc(0.25) * np.sinc(0.25 / 3)
    half = weights(64, 32)
    assert half.shape == (32, 64) and np.allclose(half.sum(1), 1) and half[16, 32] == pytest.approx(half[16, 33]) and half[16, 32] == pytest.approx(near / 2, abs=0.01)
    assert np.allclose(weights(5, 5), np.eye(5)) and np.allclose(weights(1, 4), np.ones((4, 1)))
    assert weights(2, 4)[0] == pytest.approx(np.array([np.sinc(0.25) * np.sinc(0.25 / 3), np.sinc(1.25) * np.sinc(1.25 / 3)]) / (np.sinc(0.25) * np.sinc(0.25 / 3) + np.sinc(1.25) * np.sinc(1.25 / 3)))


def test_flat_pictures_stay_flat_and_mirrors_stay_mirrors():
    assert np.allclose(resample(np.full((3, 7), 5.0), (10, 2)), 5.0)
    x = np.random.default_rng(1).normal(size=(6, 9))
    assert np.allclose(resample(x[::-1, ::-1], (4, 5)), resample(x, (4, 5))[::-1, ::-1]) and resample(x, (6, 9)) is x


def test_unequal_sizes_are_flagged(spark):
    rows = [(1, [1.0] * 4, 2, [1.0] * 6, 3), (2, [0.0, 0.0], 2, [0.0, 0.5], 2), (3, None, 2, [1.0], 1), (4, [1.0] * 3, 2, [1.0], 1), (5, [2.0] * 6, 3, [2.0], 1), (6, [1.0], None, [1.0], 1)]
    out = {r.id: (r.resized, r.similarity, r.mae) for r in compare_resized(spark.createDataFrame(rows, "id long, a array<double>, a_width int, b array<double>, b_width int"), 0.1).collect()}
    out = {k: tuple(v if v is None else round(v, 9) for v in m) for k, m in out.items()}
    assert out == {1: (True, 100.0, 0.0), 2: (False, 50.0, 0.25), 3: (None, None, None), 4: (None, None, None), 5: (True, 100.0, 0.0), 6: (None, None, None)}
