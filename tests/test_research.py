"""Hand-made cases of the research operators and equality with plain Python loops."""

import random

import pytest

from ammlytics.operators import research as R


def bars(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "pair_address string, i int, entry boolean, close double, high double, low double")


def loop(rows, tp, sl, hold, gap):
    n, i, out = len(rows), 0, []
    while i < n - 1:
        entry, close, *_ = rows[i]
        if not entry:
            i += 1
            continue
        last = min(i + hold, n - 1)
        for j in range(i + 1, last + 1):
            if rows[j][3] <= close * (1 - sl):
                out.append((i, -sl))
                break
            if rows[j][2] >= close * (1 + tp):
                out.append((i, tp))
                break
        else:
            out.append((i, rows[last][1] / close - 1))
            j = last + gap - 1
        i = j + 1
    return out


@pytest.mark.parametrize("gap", [True, False])
def test_simulate_is_the_loop(spark, gap):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        c = 100 * (1 + rng.uniform(-0.2, 0.2))
        rows.append((rng.random() < 0.3, c, c * (1 + rng.random() * 0.1), c * (1 - rng.random() * 0.1)))
    got = [(r.i, round(r.ret, 9)) for r in R.simulate(bars(spark, rows), 0.15, 0.1, 4, time_exit_gap=gap).orderBy("i").collect()]
    assert got == [(i, round(x, 9)) for i, x in loop(rows, 0.15, 0.1, 4, 2 if gap else 1)]


def test_bracket_rules_on_a_spanning_bar(spark):
    rows = [(True, 100.0, 100.0, 100.0), (False, 100.0, 116.0, 89.0)]
    got = {rule: R.simulate(bars(spark, rows), 0.15, 0.1, 5, rule=rule).first().ret for rule in ("sl_first", "tp_first", "split")}
    assert got["sl_first"] == -0.1 and got["tp_first"] == 0.15 and got["split"] == pytest.approx(0.025)


def test_time_exit_gap(spark):
    rows = [(True, 100.0, 100.0, 100.0)] * 8
    assert [r.i for r in R.simulate(bars(spark, rows), 0.5, 0.5, 1).orderBy("i").collect()] == [0, 3, 6]
    assert [r.i for r in R.simulate(bars(spark, rows), 0.5, 0.5, 1, time_exit_gap=False).orderBy("i").collect()] == [0, 2, 4, 6]


def test_shuffle_keeps_the_values(spark):
    b = bars(spark, [(False, float(i), 1.0, 1.0) for i in range(50)])
    s = R.shuffled(b, "s", ["pair_address"], ["close"])
    assert sorted(r.close for r in s.collect()) == [float(i) for i in range(50)]
    assert [r.close for r in s.orderBy("i").collect()] != [float(i) for i in range(50)]


def test_profit_factor_edges(spark):
    t = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("b", -0.2)], "pair_address string, ret double")
    got = {r.pair_address: r.pf for r in R.score(t, ["pair_address"]).collect()}
    assert got["a"] == float("inf") and got["b"] == pytest.approx(0.5)
