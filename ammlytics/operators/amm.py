"""Pools: cost curves, split routing, tick maps and slippage, sandwiches, decoding of event words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C


def split_route(pools: DataFrame, size: float, side: str = "buy", keys: list[str] | None = None) -> DataFrame:
    """Best split of an order over constant-product pools (key, pool, mid, depth, fee_bps): the level price at which all used pools end.

    Water filling in closed form: pools in order of their first marginal price b; with the cheapest m in use the common price is
    (S + sum R) / sum(R / b) (buy) or (sum R - S) / sum(R / b) (sell); m is the largest number whose dearest pool still gets a part.
    """
    keys = keys or ["token"]
    f = F.col("fee_bps") / 10_000
    buy = side == "buy"
    x = pools.where("depth > 0").withColumn("b", F.col("mid") / (1 - f) if buy else F.col("mid") * (1 - f))
    o = Window.partitionBy(*keys).orderBy(F.col("b").asc() if buy else F.col("b").desc(), "pool")
    x = x.withColumns({"_r": F.sum("depth").over(o), "_q": F.sum(F.col("depth") / F.col("b")).over(o)})
    level = (F.lit(size) + F.col("_r")) / F.col("_q") if buy else (F.col("_r") - F.lit(size)) / F.col("_q")
    x = x.withColumn("_level", level)
    used = F.col("_level") > F.col("b") if buy else F.col("_level") < F.col("b")
    final = F.max(F.when(used, F.struct("_r", "_level"))).over(Window.partitionBy(*keys))["_level"]
    x = x.withColumn("level", final)
    part = F.col("depth") * (F.col("level") / F.col("b") - 1) if buy else F.col("depth") * (1 - F.col("level") / F.col("b"))
    return x.withColumn("part", F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0))).drop("_r", "_q", "_level")


def greedy_route(pools: pd.DataFrame, size: float, side: str, steps: int = 2000) -> pd.Series:
    """The same by equal steps to the best marginal price, for one small group (parity with the closed form)."""
    filled = [0.0] * len(pools)
    rows = list(zip(pools.mid, pools.depth, pools.fee_bps / 10_000, strict=True))
    for _ in range(steps):
        prices = [m * (1 + x / r) / (1 - f) if side == "buy" else -m * (1 - x / r) * (1 - f) for (m, r, f), x in zip(rows, filled, strict=True)]
        filled[prices.index(min(prices))] += size / steps
    return pd.Series(filled, index=pools.index)


def tick_map(events: DataFrame) -> DataFrame:
    """Net liquidity change at each tick: + at the lower and - at the upper end of a position; zeros dropped."""
    legs = F.array(F.struct(F.col("tick_lower").alias("tick"), F.col("dl").alias("d")), F.struct(F.col("tick_upper").alias("tick"), (-F.col("dl")).alias("d")))
    return events.select("pool", F.explode(legs).alias("x")).groupBy("pool", "x.tick").agg(F.sum("x.d").alias("net")).where("net <> 0")


def liquidity_profile(ticks: DataFrame) -> DataFrame:
    """Active liquidity from each tick on: a running sum."""
    return ticks.withColumn("liquidity", F.sum("net").over(Window.partitionBy("pool").orderBy("tick")))


def tick_slippage(ticks: DataFrame, state: DataFrame, size: float, side: str) -> DataFrame:
    """Walk of an order through the bands of a pool from its current tick.

    ticks(pool, tick, net), state(pool, tick: current). Buying moves the root price up: a band from root a to root b with liquidity L takes
    L (b - a) of quote; selling moves it down and takes L (1/b - 1/a) of base. Bands without liquidity are jumped. One window of running
    input finds the last band; no loop over bands.
    """
    up = side == "buy"
    p = liquidity_profile(ticks).join(state.select("pool", F.col("tick").alias("now")), "pool")
    o = Window.partitionBy("pool").orderBy("tick")
    p = p.withColumn("next", F.lead("tick").over(o)).where("next is not null")
    lo, hi = (F.greatest("tick", "now"), F.col("next")) if up else (F.col("tick"), F.least("next", "now"))
    p = p.withColumns({"a": C.sqrt_price_of_tick(lo), "b": C.sqrt_price_of_tick(hi)}).where((F.col("next") > F.col("now")) if up else (F.col("tick") < F.col("now"))).where("liquidity > 0")
    take = F.col("liquidity") * (F.col("b") - F.col("a")) if up else F.col("liquidity") * (1 / F.col("a") - 1 / F.col("b"))
    give = F.col("liquidity") * (1 / F.col("a") - 1 / F.col("b")) if up else F.col("liquidity") * (F.col("b") - F.col("a"))
    p = p.withColumns({"take": take, "give": give})
    walk = Window.partitionBy("pool").orderBy(F.col("tick").asc() if up else F.col("tick").desc())
    p = p.withColumn("before", F.sum("take").over(walk) - F.col("take"))
    used = F.least(F.greatest(F.lit(size) - F.col("before"), F.lit(0.0)), F.col("take"))
    start = F.col("a") if up else F.col("b")
    # of a partly used band: the root where the input ends, and what comes out there
    end = start + used / F.col("liquidity") if up else 1 / (1 / start + used / F.col("liquidity"))
    out = F.when(used >= F.col("take"), F.col("give")).otherwise(F.col("liquidity") * (1 / start - 1 / end) if up else F.col("liquidity") * (start - end))
    p = p.withColumns({"used": used, "out": F.when(used > 0, out).otherwise(0.0)})
    g = p.groupBy("pool").agg(F.sum("used").alias("filled"), F.sum("out").alias("received"), F.count_if(F.col("used") > 0).alias("bands"), F.max("now").alias("now"))
    price = F.pow(C.sqrt_price_of_tick(F.col("now").cast("double")), F.lit(2.0))
    got = F.col("filled") / F.col("received") if up else F.col("received") / F.col("filled")
    impact = got / price - 1 if up else 1 - got / price
    return g.select("pool", "filled", "received", "bands", impact.alias("impact"), (F.col("filled") >= 0.999 * size).alias("fully_filled"))


def sandwich_candidates(trades: DataFrame) -> DataFrame:
    """Buy and next sell of one maker in one block and pair with another maker's buy between: a window for the next sell, then one
    join inside blocks."""
    t = trades.where("maker is not null and block_number is not null and log_index is not null")
    later = Window.partitionBy("pair_address", "block_number", "maker").orderBy("log_index").rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumn("sell", F.min(F.when(F.col("side") == "sell", F.col("log_index"))).over(later))
    a = t.where("side = 'buy' and sell is not null").select("pair_address", "block_number", F.col("maker").alias("attacker"), F.col("log_index").alias("front"), F.col("sell").alias("back"))
    v = trades.where("side = 'buy'").select("pair_address", "block_number", "maker", "log_index", "price_usd")
    hit = a.join(v, ["pair_address", "block_number"]).where("maker <> attacker and log_index > front and log_index < back")
    return hit.groupBy("pair_address", "block_number", "attacker", "front", "back").agg(F.count("*").alias("victims"))


def sandwich_attacks(trades: DataFrame) -> DataFrame:
    """Attacks (pair, block, attacker, front, back: places in the block): each buy with its maker's nearest later sell that no earlier attack used; if no other maker buys between, the buy is no attack and uses nothing.

    Earlier buys use a maker's sells in order and without gaps, so the nearest free sell is known by two counts: the sells before the buy, and
    the last one used. One fold over a maker's buys in a block, no search.
    """
    t = _placed(trades).where("maker is not null and s is not null")
    mine = Window.partitionBy("pair_address", "block_number", "maker").orderBy("pos")
    t = t.withColumns({"own": F.count_if(F.col("s") == "buy").over(mine), "sold": F.count_if(F.col("s") == "sell").over(mine)})
    row = F.struct("pos", "buys", "own", "sold")
    a = t.groupBy("pair_address", "block_number", "maker").agg(F.array_sort(F.collect_list(F.when(F.col("s") == "buy", row))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("s") == "sell", row))).alias("z")).where("size(b) > 0 and size(z) > 0")
    fold = F.expr("""aggregate(b, struct(0L as next, cast(array() as array<struct<front: int, back: int>>) as found),
        (acc, x) -> if(greatest(x.sold, acc.next) < size(z) and z[int(greatest(x.sold, acc.next))].buys - x.buys > z[int(greatest(x.sold, acc.next))].own - x.own,
            struct(greatest(x.sold, acc.next) + 1L as next, array_append(acc.found, struct(x.pos as front, z[int(greatest(x.sold, acc.next))].pos as back)) as found), acc)).found""")
    return a.select("pair_address", "block_number", F.col("maker").alias("attacker"), F.inline(fold))


def _placed(trades: DataFrame) -> DataFrame:
    """Trades with their place in the block, side (what doesn't begin with b sells; null stays) and the buys up to there."""
    block = Window.partitionBy("pair_address", "block_number").orderBy("log_index", "maker")
    side = F.when(F.lower("side").startswith("b"), "buy").when(F.col("side").isNotNull(), "sell")
    t = trades.where("block_number is not null and log_index is not null").select("pair_address", "block_number", "log_index", "maker", "price_usd", side.alias("s"))
    return t.withColumns({"pos": F.row_number().over(block), "buys": F.count_if(F.col("s") == "buy").over(block)})


def detect_sandwiches(trades: DataFrame, *, once: bool = True) -> DataFrame:
    """Attacks by block of at least three trades: number, victims, their mean extra price over the block's first price, trades.

    A victim is another maker's buy inside an attack: how many attacks are open at a place is a running sum of their ends, less those of
    the buyer's own. once=False counts a victim for every attack around it.
    """
    t = _placed(trades)
    ends = sandwich_attacks(trades).select("pair_address", "block_number", F.explode(F.array(F.struct(F.col("front").alias("pos"), F.lit(1).alias("d"), F.lit(1).alias("a")), F.struct(F.col("back").alias("pos"), F.lit(-1).alias("d"), F.lit(0).alias("a")))).alias("e"))
    ends = ends.groupBy("pair_address", "block_number", "e.pos").agg(F.sum("e.d").alias("d"), F.sum("e.a").alias("a"))
    block, mine = (Window.partitionBy("pair_address", "block_number", *m).orderBy("pos") for m in ((), ("maker",)))
    x = t.join(ends, ["pair_address", "block_number", "pos"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    own = F.when(F.col("maker").isNotNull(), F.sum("d").over(mine)).otherwise(0)
    open_ = F.sum("d").over(block) - own
    x = x.withColumns({"hits": F.when(F.col("s") == "buy", F.least(open_, F.lit(1)) if once else open_).otherwise(0), "pre": F.first(F.when(F.col("price_usd") > 0, F.col("price_usd")), ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    over = F.when((F.col("price_usd") > 0) & (F.col("hits") > 0), F.greatest(F.lit(0.0), F.col("price_usd") / F.col("pre") - 1))
    g = x.groupBy("pair_address", "block_number").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("attacks"), F.sum("hits").alias("victims"), F.sum(over * F.col("hits")).alias("extra_sum"), F.sum(F.when(over.isNotNull(), F.col("hits"))).alias("priced"), F.count("*").alias("trades")).where("trades >= 3")
    return g.select("pair_address", "block_number", "attacks", "victims", F.coalesce(F.col("extra_sum") / F.col("priced"), F.lit(0.0)).alias("extra"), F.coalesce("priced", F.lit(0)).alias("priced"), "trades")


def sandwich_table(trades: DataFrame, least: int = 10) -> DataFrame:
    """Per pair with enough trades: attacks, victims (once for every attack around them), their share of trades and mean extra price in basis points."""
    n = trades.where("block_number is not null and log_index is not null").groupBy("pair_address").agg(F.count("*").alias("n_trades"), F.count_distinct("block_number").alias("n_blocks")).where(F.col("n_trades") >= least)
    g = detect_sandwiches(trades, once=False).groupBy("pair_address").agg(F.sum("attacks").alias("attacks"), F.sum("victims").alias("victims"), F.sum(F.col("extra") * F.col("priced")).alias("e"), F.sum("priced").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(g, "pair_address", "left").select("pair_address", "n_trades", "n_blocks", zero("attacks").alias("attacks"), zero("victims").alias("victims"), (zero("victims") / F.col("n_trades")).alias("victim_rate"), F.coalesce(F.try_divide("e", F.nullif("p", F.lit(0))) * 1e4, F.lit(0.0)).alias("mean_extra_bp"))


def word(data: Column, i: int) -> Column:
    """The i-th 32-byte word of hex data (with 0x), 64 digits."""
    return F.substring(data, 3 + 64 * i, 64)


def hex_double(digits: Column, signed: bool = False) -> Column:
    """A 64-digit hex word as a double, folded from limbs of 16 digits; signed: two's complement."""

    def fold(x: Column) -> Column:
        out = F.lit(0.0)
        for start in (1, 17, 33, 49):
            out = out * float(16**16) + F.conv(F.substring(x, start, 16), 16, 10).cast("double")
        return out

    if not signed:
        return fold(digits)
    flipped = F.translate(F.lower(digits), "0123456789abcdef", "fedcba9876543210")
    return F.when(F.lower(F.substring(digits, 1, 1)).isin(*"89abcdef"), -(fold(flipped) + 1)).otherwise(fold(digits))


def hex_decimal(digits: Column) -> Column:
    """A hex word below 10^38 exactly, as decimal(38,0); null where it is larger."""
    # three limbs of 10 digits stay below 2^124; the digits above have to be 0
    out = F.lit(0).cast("decimal(38,0)")
    for start in (33, 43, 53):
        limb = F.conv(F.substring(digits, start, 10 if start < 53 else 12), 16, 10).cast("decimal(15,0)")
        out = (out * F.lit(16 ** (10 if start < 53 else 12)).cast("decimal(18,0)") + limb).cast("decimal(38,0)")
    return F.when(F.substring(digits, 1, 32).rlike("^0*$"), out)


def decode_sync(logs: DataFrame, decimals0: int = 18, decimals1: int = 18) -> DataFrame:
    """V2 Sync: both reserves and the price of token0 in token1."""
    r0, r1 = (hex_double(word(F.col("data"), i)) / 10.0**d for i, d in ((0, decimals0), (1, decimals1)))
    return logs.withColumns({"reserve0": r0, "reserve1": r1}).withColumn("price", F.try_divide("reserve1", F.nullif("reserve0", F.lit(0.0))))


def decode_swap_v2(logs: DataFrame, base_is_0: bool = True) -> DataFrame:
    """V2 Swap: amounts in and out; a buy takes base out."""
    a = [hex_double(word(F.col("data"), i)) for i in range(4)]
    b_in, q_in, b_out, q_out = (a[0], a[1], a[2], a[3]) if base_is_0 else (a[1], a[0], a[3], a[2])
    return logs.withColumns({"base": F.when(b_out > 0, b_out).otherwise(b_in), "quote": F.when(b_out > 0, q_in).otherwise(q_out), "side": F.when(b_out > 0, "buy").otherwise("sell"), "maker": F.col("topics")[2]})


def decode_swap_v3(logs: DataFrame, base_is_0: bool = True) -> DataFrame:
    """V3 Swap: signed amounts, root price, liquidity, tick; a buy has a negative base amount."""
    base = hex_double(word(F.col("data"), 0 if base_is_0 else 1), signed=True)
    root = hex_double(word(F.col("data"), 2)) / 2.0**96
    return logs.withColumns({"base": F.abs(base), "side": F.when(base < 0, "buy").otherwise("sell"), "price": root * root, "liquidity": hex_double(word(F.col("data"), 3)), "tick": hex_double(word(F.col("data"), 4), signed=True).cast("int")})


def decode_transfer(logs: DataFrame) -> DataFrame:
    """Transfer with three topics: parties and value (exact below 10^38)."""
    address = lambda t: F.concat(F.lit("0x"), F.lower(F.right(t, F.lit(40))))
    return logs.where(F.size("topics") >= 3).select("address", "block_number", address(F.col("topics")[1]).alias("src"), address(F.col("topics")[2]).alias("dst"), hex_decimal(word(F.col("data"), 0)).alias("value"))


def decode_pool_created(logs: DataFrame) -> DataFrame:
    """PairCreated / PoolCreated: tokens from topics, fee (hundredths of a basis point) from the third topic where there is one, pool from data."""
    address = lambda x: F.concat(F.lit("0x"), F.lower(F.right(x, F.lit(40))))
    v3 = F.size("topics") >= 4
    fee = F.when(v3, hex_double(F.substring(F.col("topics")[3], 3, 64)) / 100)
    return logs.where(F.size("topics") >= 3).select(address(F.col("topics")[1]).alias("token0"), address(F.col("topics")[2]).alias("token1"), fee.alias("fee_bps"), address(F.when(v3, word(F.col("data"), 1)).otherwise(word(F.col("data"), 0))).alias("pair_address"), "block_number")


def bonding_progress(balance: Column, reserved: Column, initial: Column) -> Column:
    return F.least(F.greatest(1 - (balance - reserved) / F.nullif(initial, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def token_balance_trades(tx: DataFrame) -> DataFrame:
    """Swaps of a pool by its vaults' balance changes: tx(sig, slot, err, pre, post: arrays of struct<vault, amount>, base_vault, quote_vault).

    Base into the pool is a sell; both vaults have to move; failed transactions are no trades.
    """
    amount = lambda side, vault: F.aggregate(F.filter(F.col(side), lambda x: x["vault"] == F.col(vault)), F.lit(0.0), lambda a, x: a + x["amount"])
    x = tx.where("err is null").withColumns({"base": amount("post", "base_vault") - amount("pre", "base_vault"), "quote": amount("post", "quote_vault") - amount("pre", "quote_vault")})
    x = x.where("base <> 0 and quote <> 0")
    return x.select("sig", "slot", F.when(F.col("base") > 0, "sell").otherwise("buy").alias("side"), F.abs("base").alias("base"), F.abs("quote").alias("quote"), F.abs(F.col("quote") / F.col("base")).alias("price"))
