"""Sandwiches, routes, decoders and safety figures against plain Python, and cases that the stand-in tables don't have."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ammlytics.functions.codecs import from_base58, on_curve, to_base58
from ammlytics.operators import amm as A
from ammlytics.operators import assembly as S
from ammlytics.operators import normalise as N
from ammlytics.operators import research as R
from ammlytics.plans import QUERIES
from ammlytics.sources.fixtures import Tables

TRADES = "pair_address string, block_number long, log_index long, maker string, side string, price_usd double"


def rule(block, once):
    """The rule for one block: (attacks, victims, mean extra)."""
    used, flagged, attacks, victims, extra = set(), set(), 0, 0, []
    pre = next((p for *_, p in block if p), None)
    for i, (m, s, _) in enumerate(block):
        if s != "buy" or m is None:
            continue
        j = next((k for k in range(i + 1, len(block)) if k not in used and block[k][:2] == (m, "sell")), None)
        if j is None:
            continue
        inside = [k for k in range(i + 1, j) if block[k][1] == "buy" and block[k][0] != m]
        if not inside:
            continue
        used.add(j)
        attacks += 1
        for k in inside:
            if once and k in flagged:
                continue
            flagged.add(k)
            victims += 1
            if pre and block[k][2]:
                extra.append(max(0.0, (block[k][2] - pre) / pre))
    return attacks, victims, sum(extra) / len(extra) if extra else 0.0


@pytest.mark.parametrize("once", [True, False])
def test_sandwiches_are_the_rule(spark, once):
    rng = random.Random(7)
    blocks = {b: [(rng.choice(["A", "B", "C", None]), rng.choice(["buy", "sell", "sell", None]) if b % 2 else rng.choice(["buy", "buy", "sell"]), rng.choice([None, 0.0, 1.0, 1.2, 2.0])) for _ in range(rng.randrange(1, 14))] for b in range(150)}
    blocks[900] = [("A", "buy", 1.0), ("A", "sell", 1.0), ("B", "buy", 1.0), ("A", "sell", 1.0)]  # the nearest sale has nobody before it: no attack
    blocks[901] = [("A", "buy", 1.0), ("C", "buy", 1.0), ("B", "buy", 1.0), ("C", "sell", 1.0), ("A", "sell", 1.0)]
    rows = [("p", b, i, m, s, p) for b, block in blocks.items() for i, (m, s, p) in enumerate(block)]
    got = {r.block_number: (r.attacks, r.victims, round(r.extra, 9)) for r in A.detect_sandwiches(spark.createDataFrame(rows, TRADES), once=once).collect()}
    want = {b: rule(block, once) for b, block in blocks.items() if len(block) >= 3}
    assert got == {b: (a, v, round(e, 9)) for b, (a, v, e) in want.items()} and got[900][0] == 0 and got[901][0] == 2


@pytest.mark.parametrize("side", ["buy", "sell"])
def test_split_is_the_greedy_one(spark, side):
    """The closed form against the best marginal price in 2,000 equal steps: within three steps for each pool."""
    rng = random.Random(11)
    pools = [(f"t{k}", f"p{i}", 1 + rng.random() / 20, 10_000 * (1 + rng.random() * 20), float(rng.choice([5, 25, 30]))) for k in range(12) for i in range(rng.randrange(1, 7))]
    frame = pd.DataFrame(pools, columns=["token", "pool", "mid", "depth", "fee_bps"])
    size = 9_000.0
    got = A.split_route(spark.createDataFrame(frame), size, side).select("token", "pool", "part").toPandas().set_index(["token", "pool"]).part
    for token, group in frame.groupby("token"):
        want = A.greedy_route(group, size, side)
        for i, row in group.iterrows():
            assert abs(got[token, row.pool] - want[i]) <= 3 * size / 2000


def test_route_summary_saves(spark):
    one = spark.createDataFrame([("t", "a", 1.0, 50_000.0, 100_000.0, 30.0)], "token string, pool string, mid double, depth double, reserve_usd double, fee_bps double")
    r = S.route_summary(one, 1000.0).first()
    assert r.pools_used == 1 and r.saved == pytest.approx(0) and r.blended_price == pytest.approx(1.02 / 0.997)
    two = one.unionByName(one.withColumn("pool", F.lit("b")))
    assert S.route_summary(two, 1000.0).first().saved > 0


def test_accounts_and_addresses(spark, sf_dir):
    rows = QUERIES["pool_accounts"](spark, sf_dir).collect()
    part = {r.p_partkey: r for r in Tables(spark, sf_dir).part.collect()}
    assert len(rows) == sum(1 for r in part.values() if r.p_size % 4 < 3)
    for r in rows:
        key = int(r.pair_address[3:])
        assert r.token0 == to_base58((key + 1).to_bytes(32, "big")) and r.token1 == to_base58((part[key].p_size + 1).to_bytes(32, "big"))
    assert all(not on_curve(from_base58(r.address)) for r in QUERIES["derived_addresses"](spark, sf_dir).collect())


def test_names_of_either_form(spark):
    word = lambda n: f"{n:064x}"
    text = "Ünïcode ✓".encode().hex()
    cases = {"0x": None, None: None, "0x" + "4d4b52".ljust(64, "0"): "MKR", "0x" + word(32) + word(len(text) // 2) + text.ljust(64, "0"): "Ünïcode ✓", "0x" + word(32) + word(9999) + "41".ljust(64, "0"): None, "0x12": None}
    got = {r.x: r.y for r in spark.createDataFrame([(k,) for k in cases], "x string").select("x", S.abi_text(F.col("x")).alias("y")).collect()}
    del got["0x" + word(32) + word(9999) + "41".ljust(64, "0")]  # a length that isn't there: read as an old word, which is no text to speak of
    assert all(got[k] == v for k, v in cases.items() if k in got)


def test_program_data_of_broken_lines(spark):
    x = spark.createDataFrame([(["Program data: !!!", "x", "Program data: aGk="],), ([],), (None,)], "m array<string>").select(S.program_data(F.col("m")).alias("d")).collect()
    assert [None if r.d is None else [bytes(b) for b in r.d] for r in x] == [[b"hi"], [], None]


def test_normalisers_of_nothing(spark):
    """Nulls, other JSON and empty objects make no error."""
    bad = spark.createDataFrame([(1, None), (2, "[]"), (3, "{}"), (4, "nonsense")], "k int, body string")
    for f in (N.pair_pools, N.listed_pools, N.token_overview, N.listed_bars, N.aggregated_bars, N.kind_trades, N.contract_safety, N.mint_safety, N.report_safety, N.simulated_safety, N.mint_account_safety):
        f(bad).collect()
    N.leg_trades(bad, F.lit("t")).collect(), N.graph_trades(bad, F.lit("t")).collect(), N.launch_feed(bad, F.lit(False)).collect(), N.curve_launches(bad, F.lit("m")).collect(), N.paged_bars(bad, "k", 5, "k").collect()


def test_close_only_stop_is_the_loop(spark):
    rng = random.Random(4)
    closes = {p: [100.0] for p in "ab"}
    rows = []
    for p, c in closes.items():
        for i in range(60):
            c.append(c[-1] * (1 + rng.uniform(-0.12, 0.12)))
        rows += [(p, i, x, rng.random() < 0.4) for i, x in enumerate(c)]
    got = sorted((r.pair_address, r.i, r.j) for r in R.simulate_close_stop(spark.createDataFrame(rows, "pair_address string, i int, close double, entry boolean"), 0.15, 5).collect())
    want = []
    for p in "ab":
        s = [(x, e) for q, _, x, e in rows if q == p]
        i = 0
        while i < len(s) - 1:
            if s[i][1]:
                end = min(i + 5, len(s) - 1)
                j = next((k for k in range(i + 1, end + 1) if s[k][0] <= s[i][0] * 0.85), end)
                want.append((p, i, j))
                i = j + 1
            else:
                i += 1
    assert got == want


def test_noise_grows_with_draws(spark):
    rows = {(r.series, r.draws): r for r in QUERIES["noise_sweep"](spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {(s, d) for s in ("real", "null") for d in (1, 2, 4)} and all(r.windows > 0 for r in rows.values())
    assert all(rows[s, 4].windows >= rows[s, 1].windows for s in ("real", "null"))
