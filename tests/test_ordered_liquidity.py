"""Order in two levels against plain Python, and liquidity windows against a loop."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ammlytics.functions import ordered
from ammlytics.operators import liquidity as L


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, 1.0, 1.0, 2.5, rng.random() * 9])) for i in range(900)]
    rows += [("one", 5000, 4.0), ("null", 5001, None)]
    return pd.DataFrame(rows, columns=["k", "i", "v"]), spark.createDataFrame(rows, "k string, i int, v double").repartition(5)


def test_running_sums(frame):
    plain, df = frame
    got = ordered.running(df, ["k"], ["i"], {"n": F.lit(1), "s": F.coalesce("v", F.lit(0.0))}).toPandas().sort_values("i").reset_index(drop=True)
    plain = plain.sort_values("i").reset_index(drop=True)
    keys = plain.k.fillna("-")
    assert got.n.tolist() == (plain.groupby(keys).cumcount() + 1).tolist()
    assert np.allclose(got.s, plain.v.fillna(0).groupby(keys).cumsum())
    whole = ordered.running(df, [], ["i"], {"n": F.lit(1)}).toPandas().sort_values("i")
    assert whole.n.tolist() == list(range(1, len(plain) + 1))


def test_average_ranks_and_counts(frame):
    plain, df = frame
    got = ordered.average_ranks(df, ["k"], "v").toPandas().sort_values("i").reset_index(drop=True)
    want = plain.v.groupby(plain.k.fillna("-")).rank(method="average")
    assert np.allclose(got.r.astype(float), want, equal_nan=True)
    c = {(r["k"], r["v"]): r for r in ordered.counted(df, ["k"], "v").collect()}
    hot = plain[plain.k == "hot"].v
    assert c[("hot", 1.0)]["c"] == (hot == 1.0).sum() and c[("hot", 2.5)]["before"] == (hot < 2.5).sum() and c[("hot", 1.0)]["n"] == hot.notna().sum()


def test_quantiles_are_exact(frame):
    plain, df = frame
    at = {"lo": 0.0, "q": 0.37, "m": 0.5, "w": 0.95, "hi": 1.0}
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", at).collect()}
    assert set(got) == {"hot", "a", "b", "one", None}
    for k in ("hot", "a", "b", "one"):
        for name, share in at.items():
            assert got[k][name] == pytest.approx(plain[plain.k == k].v.quantile(share))


def test_last_known_values(frame):
    plain, df = frame
    got = ordered.last_known(df, ["k"], ["i"], "v", "last").toPandas().sort_values("i").reset_index(drop=True)
    plain = plain.sort_values("i").reset_index(drop=True)
    assert np.allclose(got["last"].astype(float), plain.v.groupby(plain.k.fillna("-")).ffill(), equal_nan=True)


def test_ordered_work_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i int, v double")
    assert ordered.running(df, ["k"], ["i"], {"n": F.lit(1)}).count() == 0
    assert ordered.average_ranks(df, ["k"], "v").count() == 0 and ordered.quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0


def test_liquidity_windows_are_a_loop(spark):
    rng = random.Random(3)
    bars, metas = [], []
    for p in range(3):
        c = 10.0
        for i in range(45 * 4 + 20):
            c *= math.exp(rng.gauss(0, 0.12))
            bars.append((f"p{p}", i, c, rng.random() * 1e6 if i % 9 else None))
        metas.append((f"p{p}", 20_000.0 * (p + 1) if p < 2 else 0.0, 0.003, 0.2))
    bars += [("bad", i, 1.0 if i != 50 else 0.0, 1.0) for i in range(200)]
    metas.append(("bad", 1e5, 0.003, 0.2))
    got = L.provided(L.windows(spark.createDataFrame(bars, "pair_address string, i int, close double, volume double"), spark.createDataFrame(metas, "pair_address string, reserve double, fee double, gas double")))
    got = {(r["pair_address"], r["win"], r["mode"]): r for r in got.collect()}
    assert set(got) == {(f"p{p}", w, m) for p in range(2) for w in range(2) for m in ("full", "band")}
    for (pair, win, mode), r in got.items():
        mine = [b for b in bars if b[0] == pair]
        reserve = dict((m[0], m[1]) for m in metas)[pair]
        oos, sample = mine[45 * win + 90 : 45 * win + 135], mine[45 * win : 45 * win + 90]
        size = max(50.0, reserve / 400)
        closes = [b[2] for b in oos]
        mid, moves = closes[0], 0
        for c in closes[1:]:
            if not mid / 1.3 <= c <= mid * 1.3:
                mid, moves = c, moves + 1
        boost = 1 / (1 - math.sqrt(1 / 1.3)) if mode == "band" else 1.0
        fees = sum(min(b[3] or 0.0, 3 * reserve) for b in oos[1:]) * 0.003 / (reserve + size) * boost
        q = closes[-1] / closes[0]
        il = (2 * math.sqrt(q) / (1 + q) - 1) * boost
        lvr = -0.125 * sum(math.log(b / a) ** 2 for a, b in zip(closes, closes[1:], strict=False)) * boost
        gas = -(2 + (moves if mode == "band" else 0)) * 0.2 / size
        assert r["fees"] == pytest.approx(fees) and r["il"] == pytest.approx(max(-1, il)) and r["lvr"] == pytest.approx(lvr) and r["gas_frac"] == pytest.approx(gas)
        assert r["apr"] == pytest.approx((fees + max(-1, il) + lvr + gas) * 365 / 45) and r["in_range"] == pytest.approx(1 - r["moves"] / 44)
        assert r["is_yield"] == pytest.approx(sum(b[3] or 0 for b in sample) * 0.003 / reserve / 90)


def test_picks_by_yield_beat_random_ones_where_yield_tells(spark):
    rows = [(f"p{i}", w, "full", float(i), float(i) + w / 10) for i in range(9) for w in range(4)] + [("p0", 9, "full", 1.0, -5.0)]
    r = L.selection(spark.createDataFrame(rows, "pair_address string, win int, mode string, is_yield double, apr double"), ["mode"], seeds=50).first()
    assert r["picked_mean"] == pytest.approx(6.15) and r["p"] < 0.05 and r["z"] > 2 and r["n"] == 37 and r["null_mean"] == pytest.approx(4.15, abs=0.4)
