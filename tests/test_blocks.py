"""Long series in blocks against one loop: simulations and exponential means."""

import random

import pytest
from pyspark.sql import functions as F

from ammlytics.functions.rolling import ema
from ammlytics.operators import research as R

SCHEMA = "pair_address string, i int, close double, high double, low double, entry boolean"


def made(n, often, seed, pair="p"):
    rng, c, rows = random.Random(seed), 10.0, []
    for i in range(n):
        c *= 1 + rng.gauss(0, 0.03)
        rows.append((pair, i, c, c * (1 + abs(rng.gauss(0, 0.02))), c * (1 - abs(rng.gauss(0, 0.02))), rng.random() < often))
    return rows


def loop(rows, tp, sl, hold, gap):
    out, k, n = [], 0, len(rows)
    while k < n - 1:
        if not rows[k][5]:
            k += 1
            continue
        p = rows[k][2]
        hit = next((j for j in range(k + 1, min(k + hold, n - 1) + 1) if rows[j][4] <= p * (1 - sl) or rows[j][3] >= p * (1 + tp)), None)
        end = hit if hit is not None else min(k + hold, n - 1)
        ret = rows[end][2] / p - 1 if hit is None else -sl if rows[end][4] <= p * (1 - sl) else tp
        out.append((rows[k][0], k, end, round(ret, 9)))
        k = hit + 1 if hit is not None else end + gap
    return out


@pytest.mark.parametrize("often", [0.02, 0.5, 1.0])
def test_simulation_in_blocks_is_one_loop(spark, monkeypatch, often):
    monkeypatch.setattr(R, "BLOCK", 16)
    series = [made(n, often, n, f"p{n}") for n in (1, 2, 15, 16, 17, 32, 33, 500)]
    df = spark.createDataFrame([r for s in series for r in s], SCHEMA).repartition(3)
    for tp, sl, hold, gap in ((0.05, 0.04, 6, 2), (9.0, 0.9, 16, 2), (9.0, 0.9, 15, 1), (0.01, 0.01, 3, 1)):
        got = sorted((r["pair_address"], r["i"], r["j"], round(r["ret"], 9)) for r in R.simulate(df, tp, sl, hold, time_exit_gap=gap == 2).collect())
        assert got == sorted(x for s in series for x in loop(s, tp, sl, hold, gap))


def test_close_simulations_in_blocks_are_one_loop(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    rows = made(300, 0.4, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    for stop, hold, run in ((0.03, 7, lambda: R.simulate_close_stop(df, 0.03, 7)), (None, 5, lambda: R.close_to_close(df, 5))):
        want, k = [], 0
        while k < len(rows) - 1:
            if rows[k][5]:
                end = min(k + hold, len(rows) - 1)
                if stop:
                    end = next((j for j in range(k + 1, end + 1) if rows[j][2] <= rows[k][2] * (1 - stop)), end)
                want.append((k, end))
                k = end + 1
            else:
                k += 1
        assert sorted((r["i"], r["j"]) for r in run().collect()) == want


@pytest.mark.parametrize("span", [1, 2, 12, 200, 5000])
def test_exponential_mean_is_the_recursion(spark, span):
    rows = [(p, i, x) for p in ("a", "b") for i, (_, _, x, *_) in enumerate(made(1500 if p == "a" else 3, 0, 1))]
    got = {(r["k"], r["i"]): r["e"] for r in ema(spark.createDataFrame(rows, "k string, i int, x double").repartition(3), ["k"], "i", "x", span, "e").collect()}
    a, e = 2 / (span + 1), None
    for p, i, x in rows:
        e = x if i == 0 else a * x + (1 - a) * e
        assert got[(p, i)] == pytest.approx(e, rel=1e-11)


def test_a_long_series_is_many_groups(spark):
    df = spark.range(20_000).select(F.lit("p").alias("pair_address"), F.col("id").cast("int").alias("i"), (F.lit(10.0) + F.sin("id")).alias("close"), F.lit(12.0).alias("high"), F.lit(8.0).alias("low"), (F.col("id") % 7 == 0).alias("entry"))
    blocks = R._blocks(df, ["pair_address"], ["entry", "close"], 10)
    assert blocks.count() == 40 and blocks.agg(F.max(F.size("s"))).first()[0] <= R.BLOCK + 10
    assert R.simulate(df, 0.5, 0.5, 10).count() == 20_000 // 14 + 1


def test_combinations_in_blocks_are_those_of_whole_series(spark, monkeypatch):
    from ammlytics.operators import combos as O

    rows = [(p, i, x, 100.0 + (i * 7919) % 301, i < 60) for p in ("a", "b") for i, (_, _, x, *_) in enumerate(made(100 if p == "a" else 41, 0, 5, p))]
    df = spark.createDataFrame(rows, "pair_address string, i int, close double, volume double, part boolean")
    found = []
    for size in (4096, 16):
        monkeypatch.setattr(R, "BLOCK", size)
        got = O.trades(O.with_settings(df)).collect()
        found.append(sorted((r["combo"], r["pair_address"], r["part"], round(r["ret"], 9)) for r in got))
    assert found[0] == found[1] and len(O.names()) == 204
    closes = {p: [r[2] for r in rows if r[0] == p] for p in ("a", "b")}
    for p, c in closes.items():  # one of them by a loop
        want, i = [], 0
        while i < len(c) - 1:
            if i > 5 and c[i - 1] / c[i - 6] - 1 > 0.05 and i < 60:
                end = next((j for j in range(i + 1, min(i + 7, len(c) - 1) + 1) if c[j] <= c[i] * 0.85), min(i + 7, len(c) - 1))
                want.append(round(c[end] / c[i] - 1, 9))
                i = end
            i += 1
        assert sorted(want) == [x[3] for x in found[0] if x[:3] == ("momentum_L5_t0.05_h7_s0.15", p, True)]
