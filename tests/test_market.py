"""Hand-made cases of the market operators."""

import math

import pytest
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.operators import amm, market


def test_cost_of_known_trade(spark):
    row = spark.range(1).select(C.round_trip_cost(F.lit(1000.0), F.lit(400000.0), F.lit(30.0), F.lit(0.2)).alias("c"), C.price_impact(F.lit("buy"), F.lit(1000.0), F.lit(400000.0)).alias("b"), C.price_impact(F.lit("sell"), F.lit(1.0), F.lit(None).cast("double")).alias("m")).first()
    assert row.c == pytest.approx(0.016375124, abs=1e-9) and row.b == 0.005 and row.m == 1.0


def test_fee_takes_first_name_in_order(spark):
    x = spark.createDataFrame([("PancakeSwap-v3",), ("biswap",), (None,), ("x",)], "d string")
    assert [r.f for r in x.select(C.swap_fee_bps(F.col("d")).alias("f")).collect()] == [25.0, 10.0, 30.0, 30.0]


def test_concentration_of_three_holders(spark):
    x = spark.createDataFrame([("t", "a", 5), ("t", "b", 3), ("t", "c", 2)], "token string, holder string, balance long")
    r = market.concentration(x, ["token"]).first()
    assert r.top10 == 1.0 and r.hhi == pytest.approx(0.38) and r.gini == pytest.approx(0.2)


def test_balances_ignore_burn_and_zero(spark):
    x = spark.createDataFrame([("0x0", "a", 10, 1), ("a", "b", 4, 2), ("a", "0x0", 1, 3), ("a", "c", 0, 4)], "src string, dst string, value long, block long").withColumn("token", F.lit("t"))
    got = {r.holder: r.balance for r in market.balances(x, ["token"], ["0x0"]).collect()}
    s = market.supply(x, ["token"], ["0x0"]).first()
    assert got == {"a": 5, "b": 4} and sum(got.values()) == s.minted - s.burned


def test_worst_case_votes(spark):
    x = spark.createDataFrame([(1, None, ["b"]), (1, False, ["a"]), (2, None, []), (3, True, ["z"]), (3, False, ["z"])], "k int, v boolean, f array<string>").withColumn("s", F.lit(1.0))
    got = {r.k: (r.v, r.f) for r in market.worst_case(x, ["k"], ["s"], ["v"], ["f"]).collect()}
    assert got == {1: (False, ["a", "b"]), 2: (None, []), 3: (True, ["z"])}


def test_sandwich(spark):
    cols = "pair_address string, block_number long, log_index long, maker string, side string, price_usd double"
    rows = [("p", 1, 0, "A", "buy", 1.0), ("p", 1, 1, "B", "buy", 1.1), ("p", 1, 2, "A", "sell", 1.05)]
    r = amm.detect_sandwiches(spark.createDataFrame(rows, cols)).first()
    assert (r.attacks, r.victims) == (1, 1) and r.extra == pytest.approx(0.1)
    assert amm.sandwich_candidates(spark.createDataFrame(rows, cols)).count() == 1
    none = [(p, b, None, m, s, x) for p, b, _, m, s, x in rows]
    assert amm.detect_sandwiches(spark.createDataFrame(none, cols)).count() == 0


def test_tick_map_and_words(spark):
    e = spark.createDataFrame([("p", -60, 60, 10), ("p", -60, 60, -4)], "pool string, tick_lower int, tick_upper int, dl long")
    assert {r.tick: r.net for r in amm.tick_map(e).collect()} == {-60: 6, 60: -6}
    values = [0, 1, 2**112 - 1, 2**160 - 1]
    data = spark.createDataFrame([("0x" + f"{v:064x}", float(v)) for v in values], "d string, v double")
    assert all(r.x == pytest.approx(r.v, rel=1e-15) for r in data.select(amm.hex_double(amm.word(F.col("d"), 0)).alias("x"), "v").collect())
    minus = spark.createDataFrame([("0x" + "f" * 64,)], "d string").select(amm.hex_double(amm.word(F.col("d"), 0), signed=True).alias("x")).first().x
    assert minus == -1.0
    exact = [0, 7, 2**64 + 3, 2**112 - 1]
    got = spark.createDataFrame([(f"{v:064x}",) for v in exact] + [("f" * 64,)], "d string").select(amm.hex_decimal(F.col("d")).alias("x")).collect()
    assert [None if r.x is None else int(r.x) for r in got] == [*exact, None]


def test_route_close_to_greedy(spark):
    pools = spark.createDataFrame([("t", "a", 1.0, 1000.0, 30.0), ("t", "b", 1.01, 500.0, 5.0), ("t", "c", 2.0, 800.0, 30.0)], "token string, pool string, mid double, depth double, fee_bps double")
    for side in ("buy", "sell"):
        got = amm.split_route(pools, 300.0, side).orderBy("pool").toPandas()
        greedy = amm.greedy_route(got, 300.0, side)
        assert got.part.sum() == pytest.approx(300.0) and (got.part - greedy).abs().max() < 3 * 300 / 2000


def test_impermanent_loss(spark):
    assert spark.range(1).select(C.impermanent_loss(F.lit(4.0)).alias("x")).first().x == pytest.approx(-0.2)
    assert math.isinf(spark.range(1).select(C.profit_factor(F.lit(0.1), F.lit(0.0)).alias("x")).first().x)


def test_decoders(spark):
    w = lambda v: f"{v % 2**256:064x}"
    logs = spark.createDataFrame([("0xP", ["t", "0x" + "0" * 24 + "a" * 40, "0x" + "0" * 24 + "B" * 40], "0x" + w(5) + w(10) + w(0) + w(7), 3)], "address string, topics array<string>, data string, block_number long")
    s = amm.decode_swap_v2(logs).first()
    assert (s.side, s.base, s.quote) == ("sell", 5.0, 7.0)
    y = amm.decode_sync(logs, 0, 0).first()
    assert (y.reserve0, y.reserve1, y.price) == (5.0, 10.0, 2.0)
    t = amm.decode_transfer(logs).first()
    assert (t.src, t.dst, int(t.value)) == ("0x" + "a" * 40, "0x" + "b" * 40, 5)
    v3 = logs.withColumn("data", F.lit("0x" + w(-5) + w(9) + w(2**96) + w(11) + w(-7)))
    r = amm.decode_swap_v3(v3).first()
    assert (r.side, r.base, r.price, r.liquidity, r.tick) == ("buy", 5.0, 1.0, 11.0, -7)


def test_vault_trades(spark):
    row = ("s", 1, None, [("b", 5.0), ("q", 10.0)], [("b", 3.0), ("q", 14.0)], "b", "q")
    x = spark.createDataFrame([row], "sig string, slot long, err string, pre array<struct<vault:string,amount:double>>, post array<struct<vault:string,amount:double>>, base_vault string, quote_vault string")
    r = amm.token_balance_trades(x).first()
    assert (r.side, r.base, r.quote, r.price) == ("buy", 2.0, 4.0, 2.0)
