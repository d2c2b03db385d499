"""Correlations in blocks against numpy."""

import numpy as np
import pytest

from ammlytics.operators import correlation as K


def made(spark, n, d=40, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=d)
    r = rng.normal(size=(n, d)) + np.outer(rng.normal(size=n) * 0.5, base)
    r[rng.random((n, d)) < 0.3] = 0.0
    rows = [(f"s{i:04d}", t, float(r[i, t])) for i in range(n) for t in range(d) if r[i, t] != 0.0]
    return r, spark.createDataFrame([*rows, ("flat", 0, 0.0), ("few", 1, 1.0)], "s string, t int, r double")


@pytest.mark.parametrize(("n", "size", "few"), [(30, 256, 100_000), (30, 7, 100_000), (41, 16, 50), (40, 13, 3)])
def test_participation_and_median(spark, monkeypatch, n, size, few):
    monkeypatch.setattr(K, "SIZE", size)
    monkeypatch.setattr(K, "FEW", few)
    r, df = made(spark, n)
    c = np.corrcoef(r)
    upper = c[np.triu_indices(n, 1)]
    got = K.participation(df, "s", "t", "r")
    assert got[0] == n and got[1] == pytest.approx(n * n / (c * c).sum()) and got[2] == pytest.approx(np.median(np.abs(upper)), abs=1e-12)


def test_few_streams(spark):
    _, df = made(spark, 1)
    assert K.participation(df, "s", "t", "r") == (1, 1.0, None)
    assert K.participation(df.where("t < 0"), "s", "t", "r") == (0, None, None)
