from __future__ import annotations

import numpy as np
import pytest

from strataweave.operators import slopes as M


def brute(x, y):
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    return float(np.median((y[j] - y[i])[dx != 0] / dx[dx != 0])) if (dx != 0).any() else 0.0


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        v = rng.integers(0, 40, n)
        assert M.inversions(v) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))


def frame(spark, x, y):
    return spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")


def test_pairs_below_on_a_grid(spark, monkeypatch):
    """Many blocks and ranges, one x with a third of all points, ties of y and repeated points."""
    monkeypatch.setattr(M, "CELL", 60)
    rng = np.random.default_rng(2)
    x = np.where(rng.random(300) < 0.33, 7.0, rng.integers(0, 200, 300).astype(float))
    y = rng.integers(-50, 50, 300).astype(float)
    assert abs(M.median_slope(frame(spark, x, y), "x", "y") - brute(x, y)) < 1e-9


@pytest.mark.parametrize("kind", ["noise", "line", "even", "same_x", "one"])
def test_median_slope_against_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = {"noise": rng.normal(1e6, 10, 701), "line": np.arange(300.0), "even": np.array([0.0, 1.0, 3.0, 4.0]), "same_x": np.ones(20), "one": np.ones(1)}[kind]
    y = {"noise": 0.37 * x + rng.standard_cauchy(len(x)), "line": 2 * x + 5, "even": np.array([0.0, 5.0, 1.0, -7.0])}.get(kind, np.arange(float(len(x))))
    got = M.median_slope(frame(spark, x, y), "x", "y")
    assert got == pytest.approx(brute(x, y), rel=1e-9, abs=1e-9)
