"""Permutation distribution and importance against plain Python on a few days."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ammlytics.operators import ranking as K


def made():
    rng = random.Random(2)
    rows = []
    for d in range(5):
        for n in range(8 if d else 4):  # the first day has too few names
            y = rng.gauss(0, 1)
            rows.append((d, f"n{n}", round(y + rng.gauss(0, 0.8), 1), y if n != 6 else None, 1.0 if n % 2 else 0.0))
    return rows


SCHEMA = "d int, name string, s double, y double, f double"


def test_distribution_is_brute_force(spark):
    frame = pd.DataFrame(made(), columns=["d", "name", "s", "y", "f"]).dropna()
    days = [g.sort_values("name") for _, g in frame.groupby("d") if len(g) >= 5]

    def ic(s, y):
        return np.corrcoef(pd.Series(s).rank(), pd.Series(y).rank())[0, 1]

    real = np.mean([ic(g.s.values, g.y.values) for g in days])
    null = []
    for seed in range(200):
        one = []
        for g in days:
            order = sorted(range(len(g)), key=lambda i: (hashlib.md5(f"perm|{seed}|{g.d.iloc[0]}|{g['name'].iloc[i]}".encode()).hexdigest(), g["name"].iloc[i]))
            given = np.empty(len(g))
            for place, i in enumerate(order):
                given[i] = g.y.values[place]
            one.append(ic(g.s.values, given))
        null.append(np.mean(one))
    r = K.permutation_distribution(spark.createDataFrame(made(), SCHEMA), [], "d", "name", "s", "y").first()
    assert r["days"] == len(days) == 4 and r["ic"] == pytest.approx(real)
    assert r["null_mean"] == pytest.approx(np.mean(null)) and r["null_sd"] == pytest.approx(np.std(null)) and r["null_p95"] == pytest.approx(np.quantile(null, 0.95))
    assert r["p"] == pytest.approx((1 + sum(round(x, 9) >= round(real, 9) for x in null)) / 201) and r["p"] < 0.05


def test_distribution_by_keys_and_of_nothing(spark):
    df = spark.createDataFrame(made(), SCHEMA).withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = {r["k"]: (r["ic"], r["p"]) for r in K.permutation_distribution(df, ["k"], "d", "name", "s", "y", seeds=20).collect()}
    assert got["a"] == got["b"]
    assert K.permutation_distribution(df.where("d > 99"), ["k"], "d", "name", "s", "y", seeds=3).count() == 0
    assert K.permutation_distribution(df.where("d > 99"), [], "d", "name", "s", "y", seeds=3).count() == 0
    assert K.mean_ic(df, ["k"], "d", "s", "y").count() == 2


def test_only_the_named_feature_changes_names(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    got = K.with_each_shuffled(df, ["s", "f"], "d", "name").toPandas()
    assert sorted(got.variant.unique()) == ["", "f", "s"] and len(got) == 3 * df.count()
    base = got[got.variant == ""].sort_values(["d", "name"]).reset_index(drop=True)
    for v, other in (("s", "f"), ("f", "s")):
        x = got[got.variant == v].sort_values(["d", "name"]).reset_index(drop=True)
        assert (x[other] == base[other]).all() and not (x[v] == base[v]).all()
        for d in range(5):
            assert sorted(x[x.d == d][v]) == sorted(base[base.d == d][v])
