"""Trades, pools and safety figures put together from decoded chain data: logs, transactions, accounts, call results.

logs(pair_address, block_number, log_index, topics, data) are bronze rows of one event type; meta(pair_address, dec0, dec1, base_idx, quote_usd, fee_bps) says
how a pool's two tokens are read: decimals, which side is the base, what the quote is worth in USD (null: no anchor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.functions.codecs import base58_encode, curve_trade, event_discriminator
from ammlytics.functions.rolling import as_of
from ammlytics.operators.amm import hex_double, split_route, word

#: Where accounts of pool programs hold their mints, and how long such an account is (null: any).
POOL_LAYOUTS = {"raydium-v4": (400, 432, 752), "pumpswap": (43, 75, None), "orca-whirlpool": (101, 181, 653)}
#: Fixed value: native coin of the launchpad's pools.
WRAPPED_NATIVE = "0xbb4cdb9cbd36b01bd1cbaebf2de08d9173bc095c"


def address_of(digits: Column) -> Column:
    """The address in the last 40 digits of a word or topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(digits, F.lit(40))))


def _scaled(i: int, decimals: str, signed: bool = False) -> Column:
    return hex_double(word(F.col("data"), i), signed) / F.pow(F.lit(10.0), F.col(decimals))


def _maker() -> Column:
    return F.when(F.size("topics") > 2, address_of(F.col("topics")[2]))


def v2_reserves(sync: DataFrame, meta: DataFrame) -> DataFrame:
    """Sync logs as price of the base and liquidity, in USD where the quote has an anchor (else price in quote, no liquidity); no base, no row."""
    x = sync.join(meta, "pair_address").withColumns({"r0": _scaled(0, "dec0"), "r1": _scaled(1, "dec1")})
    base0 = F.col("base_idx") == 0
    x = x.withColumns({"b": F.when(base0, F.col("r0")).otherwise(F.col("r1")), "q": F.when(base0, F.col("r1")).otherwise(F.col("r0"))}).where("b > 0")
    return x.select("pair_address", "block_number", "log_index", (F.col("q") / F.col("b") * F.coalesce("quote_usd", F.lit(1.0))).alias("price"), (2 * F.col("q") * F.col("quote_usd")).alias("reserve_usd"))


def v2_trades(sync: DataFrame, swaps: DataFrame, meta: DataFrame) -> DataFrame:
    """Swap logs as trades: base out of the pool is a buy; USD by the quote's anchor; the reserve is that of the last Sync up to the swap's block."""
    x = swaps.join(meta, "pair_address").withColumns({f"a{i}": _scaled(i, f"dec{i % 2}") for i in range(4)})
    base0 = F.col("base_idx") == 0
    pick = lambda a, b: F.when(base0, F.col(a)).otherwise(F.col(b))
    x = x.withColumns({"b_in": pick("a0", "a1"), "b_out": pick("a2", "a3"), "q_in": pick("a1", "a0"), "q_out": pick("a3", "a2")})
    buy = F.col("b_out") > 0
    x = x.select("pair_address", "block_number", "log_index", F.when(buy, "buy").otherwise("sell").alias("side"), F.when(buy, F.col("b_out")).otherwise(F.col("b_in")).alias("amount_base"), F.when(buy, F.col("q_in")).otherwise(F.col("q_out")).alias("amount_quote"), "quote_usd", "fee_bps", _maker().alias("maker"))
    x = x.withColumns({"amount_usd": F.col("amount_quote") * F.col("quote_usd"), "price_usd": F.try_divide(F.col("amount_quote"), F.nullif("amount_base", F.lit(0.0))) * F.col("quote_usd")}).drop("quote_usd")
    state = v2_reserves(sync, meta).withColumnRenamed("log_index", "tie")
    return as_of(x, state, ["pair_address"], "block_number", "block_number", "reserve_usd", "tie").withColumnRenamed("reserve_usd_as_of", "reserve_usd")


def v3_trades(swaps: DataFrame, meta: DataFrame) -> DataFrame:
    """Swap logs with signed amounts as trades: price and liquidity (twice the virtual quote reserve) after the swap, from root price and liquidity."""
    x = swaps.join(meta, "pair_address").withColumns({"a0": _scaled(0, "dec0", True), "a1": _scaled(1, "dec1", True), "root": hex_double(word(F.col("data"), 2)) / 2.0**96, "l": hex_double(word(F.col("data"), 3))}).where("root > 0")
    base0 = F.col("base_idx") == 0
    price0 = F.col("root") * F.col("root") * F.pow(F.lit(10.0), F.col("dec0") - F.col("dec1"))
    virtual = F.when(base0, F.col("l") * F.col("root") / F.pow(F.lit(10.0), F.col("dec1"))).otherwise(F.col("l") / F.col("root") / F.pow(F.lit(10.0), F.col("dec0")))
    base, quote = F.when(base0, F.col("a0")).otherwise(F.col("a1")), F.abs(F.when(base0, F.col("a1")).otherwise(F.col("a0")))
    price = F.when(base0, price0).otherwise(1 / price0)
    return x.select("pair_address", "block_number", "log_index", F.when(base < 0, "buy").otherwise("sell").alias("side"), F.abs(base).alias("amount_base"), quote.alias("amount_quote"), (quote * F.col("quote_usd")).alias("amount_usd"), (price * F.col("quote_usd")).alias("price_usd"), F.when(F.col("quote_usd").isNull(), price).alias("price_native"), (2 * virtual * F.col("quote_usd")).alias("reserve_usd"), "fee_bps", _maker().alias("maker"), hex_double(word(F.col("data"), 4), True).cast("int").alias("tick"))


def curve_log_trades(logs: DataFrame, native_usd: Column | float) -> DataFrame:
    """Trades of a launchpad's manager: eight words token, account, price, amount, cost, fee, offers, funds; the curve is the pair, its funds the reserve."""
    x = logs.where(F.length("data") >= 2 + 64 * 8)
    unit = lambda i: hex_double(word(F.col("data"), i)) / 1e18
    usd = native_usd if isinstance(native_usd, Column) else F.lit(float(native_usd))
    x = x.select("block_number", "log_index", "side", address_of(word(F.col("data"), 0)).alias("pair_address"), address_of(word(F.col("data"), 1)).alias("maker"), unit(3).alias("amount_base"), unit(4).alias("amount_quote"), unit(5).alias("fee"), unit(6).alias("offered"), unit(7).alias("funds")).where("amount_base > 0")
    return x.withColumns({"price_usd": F.col("amount_quote") / F.col("amount_base") * usd, "amount_usd": F.col("amount_quote") * usd, "reserve_usd": F.col("funds") * usd})


#: The frame that wraps an event in an inner call.
SENTINEL = "1d9acb512ea545e4"


def program_data(messages: Column) -> Column:
    """Payloads of all "Program data:" lines of a transaction's log, frames taken off."""
    lines = F.filter(messages, lambda x: F.contains(x, F.lit("Program data: ")))
    raw = F.transform(lines, lambda x: F.try_to_binary(F.trim(F.substring_index(x, "Program data: ", -1)), F.lit("base64")))
    framed = lambda b: F.lower(F.hex(F.substring(b, 1, 8))) == SENTINEL
    return F.transform(F.filter(raw, lambda b: b.isNotNull()), lambda b: F.when(framed(b), F.substring(b, 9, 1 << 20)).otherwise(b))


def curve_event_trades(tx: DataFrame, native_usd: float) -> DataFrame:
    """tx(sig, slot, err, messages): trade events of bonding curves in transactions that succeeded; one a transaction and mint; the reserve is twice the virtual SOL."""
    wanted = event_discriminator("TradeEvent").hex()
    e = tx.where("err is null").select("sig", "slot", F.posexplode(program_data(F.col("messages"))).alias("pos", "blob")).where((F.lower(F.hex(F.substring("blob", 1, 8))) == wanted) & (F.length("blob") >= 113))
    once = Window.partitionBy("sig", F.hex(F.substring("blob", 9, 32))).orderBy("pos")
    e = e.withColumn("_r", F.row_number().over(once)).where("_r = 1").select("sig", "slot", curve_trade(F.col("blob")).alias("e"))
    return e.select("sig", "slot", F.col("e.mint").alias("pair_address"), F.when(F.col("e.is_buy"), "buy").otherwise("sell").alias("side"), F.col("e.tokens").alias("amount_base"), F.col("e.sol").alias("amount_quote"), (F.try_divide("e.sol", F.nullif("e.tokens", F.lit(0.0))) * native_usd).alias("price_usd"), (F.col("e.sol") * native_usd).alias("amount_usd"), (2 * F.col("e.virtual_sol") * native_usd).alias("reserve_usd"), F.col("e.maker").alias("maker"), F.col("e.sec").alias("sec"))


def creations(logs: DataFrame) -> DataFrame:
    """logs(kind, topics, data, block_number): pools of both factory versions and launchpad tokens; malformed rows are dropped."""
    t, d = F.col("topics"), F.col("data")
    v2, v3, pad = F.col("kind") == "v2", F.col("kind") == "v3", F.col("kind") == "launchpad"
    sound = (F.length(d) >= 130) & ((v2 & (F.size(t) >= 3)) | (v3 & (F.size(t) >= 4)) | pad)
    topic = lambda i: address_of(F.get(t, F.lit(i)))
    return logs.where(sound).select(
        "kind", "block_number", F.when(v3, address_of(word(d, 1))).when(v2, address_of(word(d, 0))).otherwise(address_of(word(d, 1))).alias("pair_address"), F.when(pad, address_of(word(d, 1))).otherwise(topic(1)).alias("token0"), F.when(pad, F.lit(WRAPPED_NATIVE)).otherwise(topic(2)).alias("token1"),
        F.when(v2, 25.0).when(v3, hex_double(F.substring(F.get(t, F.lit(3)), 3, 64)) / 100).alias("fee_bps"), F.when(pad, address_of(word(d, 0))).alias("creator"),
    )


def pool_accounts(accounts: DataFrame) -> DataFrame:
    """accounts(program, account, raw): mints of pool accounts by their program's layout; other programs and lengths are dropped. Creation times aren't in accounts."""
    at = {name: F.col("program") == name for name in POOL_LAYOUTS}
    pick = lambda i: F.coalesce(*[F.when(at[n], F.substring("raw", layout[i] + 1, 32)) for n, layout in POOL_LAYOUTS.items()])
    sound = F.lit(False)
    for n, (base, quote, size) in POOL_LAYOUTS.items():
        sound = sound | (at[n] & ((F.length("raw") == size) if size else (F.length("raw") >= max(base, quote) + 32)))
    x = accounts.where(sound).select("program", "account", pick(0).alias("base"), pick(1).alias("quote"))
    return x.select(F.col("program").alias("dex"), F.col("account").alias("pair_address"), base58_encode("base").alias("token0"), base58_encode("quote").alias("token1"))


def liquidity_events(logs: DataFrame) -> DataFrame:
    """Mint and Burn logs (kind) as (pool, tick_lower, tick_upper, dl): ticks from topics, the amount from word 1 (Mint) or 0 (Burn)."""
    tick = lambda i: hex_double(F.substring(F.col("topics")[i], 3, 64), True).cast("long")
    mint = F.col("kind") == "mint"
    amount = hex_double(F.when(mint, word(F.col("data"), 1)).otherwise(word(F.col("data"), 0)))
    return logs.where("size(topics) >= 4").select("pool", tick(2).alias("tick_lower"), tick(3).alias("tick_upper"), F.when(mint, amount).otherwise(-amount).cast("long").alias("dl"))


def abi_text(result: Column) -> Column:
    """The text of a name or symbol call: offset, length and bytes, or the old form of one word padded with zeros; null if neither."""
    h = F.lower(F.regexp_replace(result, "^0x", ""))
    length = F.conv(F.ltrim(F.substring(h, 65, 64), F.lit("0")), 16, 10).try_cast("int")
    dynamic = (F.substring(h, 1, 64) == "0" * 62 + "20") & (length > 0) & (length * 2 <= F.length(h) - 128)
    body = F.when(dynamic, F.expr("null").cast("string"))
    body = F.when(dynamic, F.substring(h, F.lit(129), length * 2)).otherwise(F.regexp_replace(F.substring(h, 1, 64), "(00)*$", ""))
    shown = F.trim(F.try_validate_utf8(F.decode(F.unhex(body), "UTF-8")))
    return F.when(F.length(h) >= 64, F.nullif(shown, F.lit("")))


def pools_with_token(logs: DataFrame, token: str) -> DataFrame:
    """Creations that name a token on either side."""
    return creations(logs).where((F.col("token0") == token.lower()) | (F.col("token1") == token.lower()))


# Depth, cost, value -------------------------------------------------------------------------------------------------------------


def pool_depth(state: DataFrame, native_usd: float | None = None) -> DataFrame:
    """state(pair_address, dec0, dec1, stable_idx, fee_word, reserves, slot0, liquidity): price, reserve and fee of each pool, as routing takes them.

    A pool with a fee is of version 3 (hundredths of a basis point; virtual reserves), else version 2 at 25 basis points. The quote is the stable side,
    else token1; a quote that is no stable is worth native_usd. A pool without a quote reserve is no row.
    """
    fee = hex_double(F.substring("fee_word", 3, 64))
    v3 = F.coalesce(fee > 0, F.lit(False))
    base0 = ~F.coalesce(F.col("stable_idx") == 0, F.lit(False))
    d0, d1 = F.pow(F.lit(10.0), F.col("dec0")), F.pow(F.lit(10.0), F.col("dec1"))
    root, liquid = hex_double(word(F.col("slot0"), 0)) / 2.0**96, hex_double(F.substring("liquidity", 3, 64))
    x0 = F.when(v3, liquid / F.nullif(root, F.lit(0.0)) / d0).otherwise(hex_double(word(F.col("reserves"), 0)) / d0)
    x1 = F.when(v3, liquid * root / d1).otherwise(hex_double(word(F.col("reserves"), 1)) / d1)
    x = state.withColumns({"_b": F.when(base0, x0).otherwise(x1), "_q": F.when(base0, x1).otherwise(x0), "kind": F.when(v3, "v3").otherwise("v2"), "fee_bps": F.when(v3, fee / 100).otherwise(25.0)})
    usd = F.when(F.col("stable_idx").isNotNull(), 1.0).otherwise(F.lit(native_usd if native_usd is not None else 1.0))
    return x.where("_q > 0 and _b > 0").select("pair_address", "kind", "fee_bps", (F.col("_q") / F.col("_b") * usd).alias("price_usd"), (2 * F.col("_q") * usd).alias("reserve_usd"), (F.col("_q") * usd).alias("reserve_base_usd"))


def routable(pools: DataFrame) -> DataFrame:
    """Pools as routing takes them: the reserve is the total, else twice the base leg; the fee is given, else known from the venue; unpriced and empty ones are left out."""
    reserve = F.coalesce("reserve_usd", 2 * F.col("reserve_base_usd"), F.lit(0.0))
    x = pools.withColumns({"reserve_usd": reserve, "fee_bps": F.coalesce(F.col("fee_bps").cast("double"), C.swap_fee_bps(F.col("dex")))})
    return x.where("reserve_usd > 0 and price_usd > 0").withColumns({"mid": F.col("price_usd"), "depth": F.col("reserve_usd") / 2})


def route_summary(pools: DataFrame, size: float, side: str = "buy") -> DataFrame:
    """Of routable pools(token, pool, mid, depth, reserve_usd, fee_bps): blended price and impact of the best split, cost against the deepest pool's price, and what that saves over the deepest pool alone."""
    buy = side == "buy"
    x = split_route(pools, size, side)
    f = F.col("fee_bps") / 10_000
    price = lambda s, impact: F.col("mid") * (1 + impact) / (1 - f) if buy else F.col("mid") * (1 - impact) * (1 - f)
    impact = lambda s: C.price_impact(F.lit(side), s, F.col("reserve_usd"))
    x = x.withColumns({"_impact": impact(F.col("part")), "_alone": price(None, impact(F.lit(size)))}).withColumn("_price", price(None, F.col("_impact")))
    deepest = lambda c: F.max_by(c, F.struct("reserve_usd", "pool"))
    used = F.sum("part")
    g = x.groupBy("token").agg(F.count_if(F.col("part") > 0).alias("pools_used"), (used / F.sum(F.col("part") / F.col("_price"))).alias("blended_price"), (F.sum(F.col("_impact") * F.col("part")) / used).alias("blended_impact"), deepest("mid").alias("ref"), deepest("_alone").alias("alone"))
    cost = lambda p: (F.col(p) - F.col("ref")) / F.col("ref") if buy else (F.col("ref") - F.col(p)) / F.col("ref")
    return g.select("token", "pools_used", "blended_price", "blended_impact", cost("blended_price").alias("total_cost"), (cost("alone") - cost("blended_price")).alias("saved"))


def routed_cost_curve(pools: DataFrame, sizes: list[float], gas: Column | float = 0.2) -> DataFrame:
    """By token and size: impact of the best split, saving over the deepest pool, and the round trip through that pool alone."""
    out = None
    top = pools.groupBy("token").agg(F.max_by(F.struct("reserve_usd", "fee_bps"), F.struct("reserve_usd", "pool")).alias("d"))
    for size in sizes:
        g = gas if isinstance(gas, Column) else F.lit(gas)
        alone = top.select("token", C.round_trip_cost(F.lit(float(size)), F.col("d.reserve_usd"), F.col("d.fee_bps"), g).alias("single_pool_round_trip"))
        one = route_summary(pools, float(size)).join(alone, "token").withColumn("size_usd", F.lit(float(size)))
        out = one if out is None else out.unionByName(one)
    return out


def backtest_frame(bars: DataFrame, size: float, fee_bps: Column, gas: Column, reserve: Column | None = None, latency: int = 0) -> DataFrame:
    """bars(pair_address, ts, open..volume, reserve_usd, seq): one bar a time (the first by seq), the fallback where a bar has no reserve, the price ``latency`` bars on, and the round-trip cost of size."""
    once = bars.withColumn("_r", F.row_number().over(Window.partitionBy("pair_address", "ts").orderBy("seq"))).where("_r = 1").drop("_r", "seq")
    x = once.withColumn("reserve_usd", F.coalesce("reserve_usd", reserve) if reserve is not None else F.col("reserve_usd"))
    x = x.withColumn("rt_cost_frac", C.round_trip_cost(F.lit(float(size)), F.col("reserve_usd"), fee_bps, gas))
    return x.withColumn("fill_price", F.lead("open", latency).over(Window.partitionBy("pair_address").orderBy("ts"))) if latency else x


def pool_value(pools: DataFrame, token: Column, stables: list[str], native: str, native_usd: float, supply: Column) -> DataFrame:
    """pools(token0, token1, amount0, amount1, root): price of a token by its quote (stable, native coin or none), liquidity, market value. With a root price that decides, not the balances."""
    base0 = F.col("token1") != token
    quote = F.when(base0, F.col("token1")).otherwise(F.col("token0"))
    b, q = F.when(base0, F.col("amount0")).otherwise(F.col("amount1")), F.when(base0, F.col("amount1")).otherwise(F.col("amount0"))
    by_root = F.when(base0, F.col("root") * F.col("root")).otherwise(1 / (F.col("root") * F.col("root")))
    price = F.coalesce(by_root, F.try_divide(q, F.nullif(b, F.lit(0.0))))
    usd = F.when(quote.isin(*stables), 1.0).when(quote == native, float(native_usd))
    return pools.withColumns({"price_usd": price * usd, "price_native": F.when(quote == native, price), "liquidity_usd": 2 * q * usd, "market_cap": price * usd * supply})


def lp_safety(held: DataFrame, dead: list[str], lockers: dict[str, str]) -> DataFrame:
    """held(pair_address, holder, balance, supply) of a pool's share token: burned and locked fractions, flags from one half on."""
    x = held.groupBy("pair_address").agg(F.max("supply").alias("s"), F.sum(F.when(F.col("holder").isin(*dead), F.col("balance")).otherwise(0)).alias("b"), F.sum(F.when(F.col("holder").isin(*lockers), F.col("balance")).otherwise(0)).alias("l")).where("s > 0")
    burned, locked = F.least(F.col("b") / F.col("s"), F.lit(1.0)), F.least(F.col("l") / F.col("s"), F.lit(1.0))
    show = lambda name, v: F.when(v >= 0.5, F.concat(F.lit(f"LP {name} ~"), F.format_number(v * 100, 0), F.lit("%")))
    flags = F.array(show("burned", burned), show("locked", locked), F.when((burned < 0.5) & (locked < 0.5), "LP not majority-burned/locked"))
    return x.select("pair_address", burned.alias("lp_burned_pct"), locked.alias("lp_locked_pct"), F.filter(flags, lambda f: f.isNotNull()).alias("flags"))


def round_trip_tax(probe: DataFrame) -> DataFrame:
    """probe(reverted, bought, expected, back, expected_back): taxes of a simulated buy and sale; a sale that fails, gives nothing or loses 99 % is a trap, a buy that fails too."""
    tax = lambda got, want: F.round(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col(got), F.nullif(F.col(want), F.lit(0.0)))), 4)
    known = F.coalesce(F.col("expected"), F.lit(0.0)) > 0
    sale = tax("back", "expected_back")
    trap = F.when(~known, None).when(F.col("reverted"), True).otherwise((F.col("back") == 0) | F.coalesce(sale >= 0.99, F.lit(False)))
    return probe.withColumns({"is_honeypot": trap, "buy_tax": F.when(known & (F.coalesce("bought", F.lit(0.0)) > 0), tax("bought", "expected")), "sell_tax": F.when(known, F.when(F.col("reverted") & (F.coalesce("bought", F.lit(0.0)) > 0), 1.0).when(~F.col("reverted"), sale))})


def owner_balances(accounts: DataFrame, keys: list[str]) -> DataFrame:
    """Token accounts summed by owner; owners with nothing are left out."""
    return accounts.groupBy(*keys, "owner").agg(F.sum("amount").alias("balance")).where("balance <> 0")


def supply_concentration(held: DataFrame, keys: list[str], supply: Column, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Shares of the largest holders and Herfindahl index over a supply (the held sum where it is null or not positive)."""
    w = Window.partitionBy(*keys)
    x = held.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("balance"), "owner")), "_t": F.when(supply > 0, supply).otherwise(F.sum("balance").over(w))})
    share = F.col("balance") / F.col("_t")
    return x.groupBy(*keys).agg(F.count("*").alias("holder_count"), *[F.sum(F.when(F.col("_r") <= t, share).otherwise(0.0)).alias(f"top{t}_pct") for t in tops], F.sum(share * share).alias("hhi"))
