"""Queries over chain data: the stand-in tables are written as hex words, log lines and account bytes, the operators read them back into trades and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammlytics.functions.codecs import event_discriminator, from_base58, program_address, to_base58
from ammlytics.operators import amm as A
from ammlytics.operators import assembly as S
from ammlytics.operators import market as M
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query


def word(x: str) -> str:
    """A number as a 32-byte word (SQL): two's complement below zero."""
    return f"lpad(lower(hex(CAST({x} AS BIGINT))), 64, CASE WHEN {x} < 0 THEN 'f' ELSE '0' END)"


def address(x: str) -> str:
    return f"lpad(lower(hex(CAST({x} AS BIGINT))), 40, '0')"


def topics(*x: str) -> str:
    return f"array('0x00', {', '.join(x)})"


_META = "SELECT DISTINCT user_id AS pair, user_id % 2 AS base_idx, CASE WHEN user_id % 5 <> 0 THEN 2.0 END AS quote_usd FROM events"
_SWAP = "SELECT event_id, user_id AS pair, event_id // 10 AS block_number, event_type IN ('purchase', 'signup') AS buy, (1000 + event_id % 500) / 100.0 AS b, floor(value * 100) / 1000.0 AS q FROM events"
_SYNC = "SELECT event_id, user_id AS pair, event_id // 10 AS block_number, (100000 + event_id % 1000) / 100.0 AS r0, (50000 + event_id % 777) / 1000.0 AS r1 FROM events WHERE event_id % 3 = 0"


def meta(t):
    return t.events.selectExpr("concat('pool', user_id) AS pair_address", "CAST(2 AS DOUBLE) AS dec0", "CAST(3 AS DOUBLE) AS dec1", "user_id % 2 AS base_idx", "CASE WHEN user_id % 5 <> 0 THEN 2.0D END AS quote_usd", "25.0D AS fee_bps").distinct()


_KEY = ["concat('pool', user_id) AS pair_address", "event_id div 10 AS block_number", "event_id AS log_index"]


def sync_logs(t):
    return t.events.where("event_id % 3 = 0").selectExpr(*_KEY, "array('0x00') AS topics", f"concat('0x', {word('100000 + event_id % 1000')}, {word('50000 + event_id % 777')}) AS data")


def swap_logs(t):
    # the base is token0 (two decimals) or token1 (three); its raw amount is scaled so that both read the same
    buy, base0 = "event_type IN ('purchase', 'signup')", "user_id % 2 = 0"
    b, q = f"(1000 + event_id % 500) * CASE WHEN {base0} THEN 1 ELSE 10 END", "CAST(floor(value * 100) AS BIGINT)"
    amount = lambda side, token: f"CASE WHEN ({buy}) = {'true' if side == 'out' else 'false'} THEN CASE WHEN ({base0}) = {'true' if token == 0 else 'false'} THEN {b} ELSE 0 END ELSE CASE WHEN ({base0}) = {'false' if token == 0 else 'true'} THEN {q} ELSE 0 END END"
    data = ", ".join(word(f"({amount(side, token)})") for side in ("in", "out") for token in (0, 1))
    return t.events.selectExpr(*_KEY, f"{topics(repr('0x01'), 'concat(' + repr('0x') + ', lpad(' + address('user_id') + ', 64, ' + repr('0') + '))')} AS topics", f"concat('0x', {data}) AS data")


_V2 = f"""WITH m AS ({_META}), w AS ({_SWAP}), y AS ({_SYNC}),
r AS (SELECT y.pair, block_number, arg_max(2 * CASE WHEN base_idx = 0 THEN r1 ELSE r0 END * quote_usd, event_id) AS reserve_usd FROM y JOIN m USING (pair) GROUP BY 1, 2),
x AS (SELECT w.*, m.quote_usd, m.base_idx, CASE WHEN m.base_idx = 0 THEN q ELSE q * 10 END AS qq FROM w JOIN m USING (pair))
SELECT x.event_id AS log_index, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side, round(b, 6) AS amount_base, round(qq, 6) AS amount_quote, round(qq * quote_usd, 6) AS amount_usd, round(qq / b * quote_usd, 6) AS price_usd, round(r.reserve_usd, 6) AS reserve_usd,
 '0x' || lpad(lower(to_hex(x.pair)), 40, '0') AS maker FROM x ASOF LEFT JOIN r ON r.pair = x.pair AND r.block_number <= x.block_number"""


@query("v2_trades", _V2)
def _(t):
    x = S.v2_trades(sync_logs(t), swap_logs(t), meta(t))
    return rounded(x.select("log_index", "side", "amount_base", "amount_quote", "amount_usd", "price_usd", "reserve_usd", "maker"))


@query("v2_sync_bars", f"WITH m AS ({_META}), y AS ({_SYNC}), p AS (SELECT y.pair, block_number // 6 AS bucket, event_id, CASE WHEN base_idx = 0 THEN r1 / r0 ELSE r0 / r1 END * coalesce(quote_usd, 1) AS price, 2 * CASE WHEN base_idx = 0 THEN r1 ELSE r0 END * quote_usd AS reserve FROM y JOIN m USING (pair)), w AS ({_SWAP}), v AS (SELECT w.pair, block_number // 6 AS bucket, sum(CASE WHEN base_idx = 0 THEN q ELSE q * 10 END * quote_usd) AS volume, count(*) AS n FROM w JOIN m USING (pair) GROUP BY 1, 2), b AS (SELECT pair, bucket, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, arg_max(reserve, event_id) AS reserve_usd FROM p GROUP BY 1, 2) SELECT 'pool' || pair AS pair_address, bucket, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(reserve_usd, 6) AS reserve_usd, round(nullif(volume, 0), 6) AS volume, n AS trade_count FROM b LEFT JOIN v USING (pair, bucket)")
def _(t):
    """Price and reserve of a bar from Sync, volume and count from Swap where the bar has a Sync."""
    y = S.v2_reserves(sync_logs(t), meta(t)).withColumn("bucket", F.floor(F.col("block_number") / 6))
    b = y.groupBy("pair_address", "bucket").agg(F.min_by("price", "log_index").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "log_index").alias("close"), F.max_by("reserve_usd", "log_index").alias("reserve_usd"))
    v = S.v2_trades(sync_logs(t), swap_logs(t), meta(t)).withColumn("bucket", F.floor(F.col("block_number") / 6)).groupBy("pair_address", "bucket").agg(F.sum("amount_usd").alias("v"), F.count("*").alias("trade_count"))
    x = b.join(v, ["pair_address", "bucket"], "left")
    return x.select("pair_address", "bucket", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], F.round("reserve_usd", 6).alias("reserve_usd"), F.round(F.nullif("v", F.lit(0.0)), 6).alias("volume"), "trade_count")


_SIGN = "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END"
_V3 = f"WITH m AS ({_META}), x AS (SELECT event_id, user_id AS pair, event_id // 10 AS block_number, {_SIGN} AS g, (1000 + event_id % 500) AS a0, (700 + event_id % 300) AS a1, 1 + event_id % 9 AS k, 1000000 + event_id AS l, event_id % 200 - 100 AS tick FROM events), y AS (SELECT x.*, base_idx, quote_usd, CASE WHEN base_idx = 0 THEN a0 / 100.0 ELSE a1 / 1000.0 END AS b, CASE WHEN base_idx = 0 THEN a1 / 1000.0 ELSE a0 / 100.0 END AS q, CASE WHEN base_idx = 0 THEN k * k / 10.0 ELSE 10.0 / (k * k) END AS price, CASE WHEN base_idx = 0 THEN l * k / 1000.0 ELSE l / CAST(k AS DOUBLE) / 100.0 END AS virtual FROM x JOIN m USING (pair))"


def v3_logs(t):
    # what a buyer gets leaves the pool: the base amount is negative, the other one positive
    base0 = "user_id % 2 = 0"
    a0, a1 = f"((1000 + event_id % 500) * -({_SIGN}) * CASE WHEN {base0} THEN 1 ELSE -1 END)", f"((700 + event_id % 300) * ({_SIGN}) * CASE WHEN {base0} THEN 1 ELSE -1 END)"
    root = f"lpad(concat(lower(hex(1 + event_id % 9)), repeat('0', 24)), 64, '0')"
    data = f"concat('0x', {word(a0)}, {word(a1)}, {root}, {word('1000000 + event_id')}, {word('(event_id % 200 - 100)')})"
    return t.events.selectExpr(*_KEY, f"{topics(repr('0x01'), repr('0x' + '0' * 63 + '7'))} AS topics", f"{data} AS data")


@query("v3_trades", f"{_V3} SELECT event_id AS log_index, CASE WHEN g = 1 THEN 'buy' ELSE 'sell' END AS side, round(b, 6) AS amount_base, round(q, 6) AS amount_quote, round(q * quote_usd, 6) AS amount_usd, round(price * quote_usd, 8) AS price_usd, round(CASE WHEN quote_usd IS NULL THEN price END, 8) AS price_native, round(2 * virtual * quote_usd, 4) AS reserve_usd, CAST(tick AS INT) AS tick FROM y")
def _(t):
    x = S.v3_trades(v3_logs(t), meta(t))
    return x.select("log_index", "side", F.round("amount_base", 6).alias("amount_base"), F.round("amount_quote", 6).alias("amount_quote"), F.round("amount_usd", 6).alias("amount_usd"), F.round("price_usd", 8).alias("price_usd"), F.round("price_native", 8).alias("price_native"), F.round("reserve_usd", 4).alias("reserve_usd"), "tick")


@query("v3_bars", f"{_V3} SELECT 'pool' || pair AS pair_address, block_number // 6 AS bucket, round(arg_min(coalesce(price * quote_usd, price), event_id), 8) AS open, round(max(coalesce(price * quote_usd, price)), 8) AS high, round(min(coalesce(price * quote_usd, price)), 8) AS low, round(arg_max(coalesce(price * quote_usd, price), event_id), 8) AS close, round(sum(q * quote_usd), 6) AS volume, count(*) AS trade_count FROM y GROUP BY 1, 2")
def _(t):
    x = S.v3_trades(v3_logs(t), meta(t)).withColumns({"bucket": F.floor(F.col("block_number") / 6), "p": F.coalesce("price_usd", "price_native")})
    b = x.groupBy("pair_address", "bucket").agg(F.min_by("p", "log_index").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "log_index").alias("close"), F.round(F.sum("amount_usd"), 6).alias("volume"), F.count("*").alias("trade_count"))
    return b.select("pair_address", "bucket", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume", "trade_count")


@query("curve_log_trades", "SELECT event_id AS log_index, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS pair_address, round(event_id % 50 + 1, 6) AS amount_base, round(event_id % 7, 6) AS amount_quote, round((event_id % 7) * 600.0 / (event_id % 50 + 1), 6) AS price_usd, round((event_id % 20) * 600.0, 6) AS reserve_usd FROM events WHERE event_id % 13 <> 0")
def _(t):
    side = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side"
    raw = t.events.selectExpr("event_id div 10 AS block_number", "event_id AS log_index", side, "user_id", "event_id")
    small = F.col("event_id")
    words = [F.lpad(F.lower(F.hex("user_id")), 64, "0"), F.lpad(F.lit("7"), 64, "0"), F.lpad(F.lit("1"), 64, "0"), big(F.when(small % 13 == 0, 0).otherwise(small % 50 + 1)), big(small % 7), big(F.lit(0)), big(F.lit(1)), big(small % 20)]
    logs = raw.select("block_number", "log_index", "side", F.concat(F.lit("0x"), *words).alias("data"))
    x = S.curve_log_trades(logs, 600.0)
    return rounded(x.select("log_index", "side", "pair_address", "amount_base", "amount_quote", "price_usd", "reserve_usd"))


def big(n):
    """n times 10^18 as a word: n times 5^18 in hex, then 18 binary places, which are four hex digits and two bits."""
    return F.lpad(F.concat(F.lower(F.hex(n.cast("long") * (5**18) * 4)), F.lit("0000")), 64, "0")


@query("curve_event_trades", "SELECT event_id AS slot, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round((event_id % 90 + 1) / 1e6, 9) AS amount_base, round((event_id % 1000 + 1) / 1e9, 12) AS amount_quote, round((event_id % 1000 + 1) / 1e9 * 150, 9) AS amount_usd, round(2 * (30000000000 + event_id) / 1e9 * 150, 4) AS reserve_usd, 1700000000 + event_id AS sec FROM events WHERE event_id % 11 <> 0")
def _(t):
    little = lambda x: "concat(" + ", ".join(f"substring(lpad(hex(CAST({x} AS BIGINT)), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + ")"
    event = ["'" + event_discriminator("TradeEvent").hex() + "'", "lpad(hex(user_id + 1), 64, '0')", little("event_id % 1000 + 1"), little("event_id % 90 + 1"), "CASE WHEN event_id % 2 = 0 THEN '01' ELSE '00' END", "lpad('5', 64, '0')", little("1700000000 + event_id"), little("30000000000 + event_id"), little("1073000000000000"), little("1"), little("2")]
    frame = f"CASE WHEN event_id % 3 = 0 THEN '{S.SENTINEL}' ELSE '' END"
    line = f"concat('Program data: ', base64(unhex(concat({frame}, {', '.join(event)}))))"
    # the same event twice is one trade; other lines and broken payloads are none
    tx = t.events.selectExpr("concat('s', event_id) AS sig", "event_id AS slot", "CASE WHEN event_id % 11 = 0 THEN 'failed' END AS err", f"array('Program log: hi', 'Program data: ???', {line}, {line}) AS messages")
    x = S.curve_event_trades(tx, 150.0)
    return x.select("slot", "side", F.round("amount_base", 9).alias("amount_base"), F.round("amount_quote", 12).alias("amount_quote"), F.round("amount_usd", 9).alias("amount_usd"), F.round("reserve_usd", 4).alias("reserve_usd"), "sec")


@query("vault_trades", "SELECT event_id AS slot, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side, round(1 + event_id % 9, 6) AS base, round(value, 6) AS quote, round(value / (1 + event_id % 9), 6) AS price FROM events WHERE event_id % 8 <> 0 AND value <> 0")
def _(t):
    g = "CASE WHEN event_type IN ('purchase', 'signup') THEN -1 ELSE 1 END"
    pre = "array(named_struct('vault', 'b', 'amount', 1000.0D), named_struct('vault', 'q', 'amount', 0.0D), named_struct('vault', 'z', 'amount', 3.0D))"
    post = f"array(named_struct('vault', 'b', 'amount', 1000.0D + {g} * (1 + event_id % 9)), named_struct('vault', 'q', 'amount', -({g}) * value), named_struct('vault', 'z', 'amount', 9.0D))"
    tx = t.events.selectExpr("concat('s', event_id) AS sig", "event_id AS slot", "CASE WHEN event_id % 8 = 0 THEN 'failed' END AS err", f"{pre} AS pre", f"{post} AS post", "'b' AS base_vault", "'q' AS quote_vault")
    return rounded(A.token_balance_trades(tx).select("slot", "side", "base", "quote", "price"))


@query("creation_logs", f"SELECT p_partkey AS block_number, CASE p_size % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'launchpad' END AS kind, '0x' || lpad(lower(to_hex(p_partkey + 1000)), 40, '0') AS pair_address, CASE WHEN p_size % 3 = 2 THEN '0x' || lpad(lower(to_hex(p_partkey + 1000)), 40, '0') ELSE '0x' || lpad(lower(to_hex(p_partkey)), 40, '0') END AS token0, CASE WHEN p_size % 3 = 2 THEN '{S.WRAPPED_NATIVE}' ELSE '0x' || lpad(lower(to_hex(p_size)), 40, '0') END AS token1, CASE p_size % 3 WHEN 0 THEN 25.0 WHEN 1 THEN p_size * 5.0 END AS fee_bps FROM part WHERE p_partkey % 9 <> 0")
def _(t):
    topic = lambda x: f"concat('0x', {word(x)})"
    first, second = "CASE p_size % 3 WHEN 0 THEN p_partkey + 1000 WHEN 1 THEN 60 ELSE 5 END", "p_partkey + 1000"
    logs = t.part.selectExpr("CASE p_size % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'launchpad' END AS kind", "p_partkey AS block_number", f"CASE WHEN p_size % 3 = 2 THEN array('0x00') ELSE array('0x00', {topic('p_partkey')}, {topic('p_size')}, {topic('p_size * 500')}) END AS topics", f"CASE WHEN p_partkey % 9 = 0 THEN '0x12' ELSE concat('0x', {word('(' + first + ')')}, {word('(' + second + ')')}) END AS data")
    return S.creations(logs).select("block_number", "kind", "pair_address", "token0", "token1", "fee_bps")


@query("transfer_log_balances", "WITH l AS (SELECT token, src, dst, value FROM transfers WHERE value <> 0), g AS (SELECT token, dst AS holder, value AS v FROM l UNION ALL SELECT token, src, -value FROM l) SELECT token, holder, CAST(sum(v) AS BIGINT) AS balance FROM g WHERE holder <> '0x0' GROUP BY 1, 2 HAVING sum(v) > 0")
def _(t):
    """Balances netted from Transfer logs; a log of two topics is no transfer."""
    who = lambda c: f"CASE WHEN {c} = '0x0' THEN 0 ELSE CAST(substring({c}, 2) AS BIGINT) + 1 END"
    logs = t.transfers.selectExpr("concat('token', token) AS address", "block AS block_number", f"array('0x00', concat('0x', {word('(' + who('src') + ')')}), concat('0x', {word('(' + who('dst') + ')')})) AS topics", f"concat('0x', {word('value')}) AS data")
    logs = logs.unionByName(logs.withColumn("topics", F.slice("topics", 1, 2)))
    x = A.decode_transfer(logs).withColumnsRenamed({"address": "token", "block_number": "block"})
    zero = "0x" + "0" * 40
    b = M.balances(x, ["token"], [zero])
    name = F.concat(F.lit("a"), (F.conv(F.substring("holder", 3, 40), 16, 10).cast("long") - 1).cast("string"))
    return b.select(F.substring("token", 6, 9).cast("long").alias("token"), name.alias("holder"), F.col("balance").cast("long").alias("balance"))


@query("liquidity_logs", "SELECT pool, tick, CAST(sum(d) AS BIGINT) AS net FROM (SELECT pool, tick_lower AS tick, dl AS d FROM liquidity UNION ALL SELECT pool, tick_upper, -dl FROM liquidity) GROUP BY 1, 2 HAVING sum(d) <> 0")
def _(t):
    """The tick map from Mint and Burn logs."""
    topic = lambda x: f"concat('0x', {word(x)})"
    logs = t.liquidity.selectExpr("pool", "CASE WHEN dl > 0 THEN 'mint' ELSE 'burn' END AS kind", f"array('0x00', '0x01', {topic('tick_lower')}, {topic('tick_upper')}) AS topics", f"CASE WHEN dl > 0 THEN concat('0x', {word('99')}, {word('dl')}) ELSE concat('0x', {word('-dl')}, {word('99')}) END AS data")
    return A.tick_map(S.liquidity_events(logs)).select("pool", "tick", F.col("net").cast("long").alias("net"))


@query("token_names", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name FROM part")
def _(t):
    dynamic = f"concat('0x', {word('32')}, {word('length(p_name)')}, rpad(lower(hex(encode(p_name, 'utf-8'))), 128, '0'))"
    old = "concat('0x', rpad(lower(hex(encode(p_name, 'utf-8'))), 64, '0'))"
    x = t.part.selectExpr("p_partkey", f"CASE WHEN p_partkey % 7 = 0 THEN '0x' WHEN p_partkey % 2 = 0 AND length(p_name) < 32 THEN {old} ELSE {dynamic} END AS result")
    return x.select("p_partkey", S.abi_text(F.col("result")).alias("name"))


@query("pool_accounts")
def _(t):
    """Mints of pool accounts, by the layout of their program (base58, which SQL can't say)."""
    program = "CASE p_size % 4 WHEN 0 THEN 'raydium-v4' WHEN 1 THEN 'pumpswap' WHEN 2 THEN 'orca-whirlpool' ELSE 'other' END"
    key = lambda x: f"lpad(hex({x} + 1), 64, '0')"
    raw = "CASE p_size % 4 " + " ".join(f"WHEN {i} THEN unhex(concat(repeat('00', {b}), {key('p_partkey')}, repeat('00', {q - b - 32}), {key('p_size')}, repeat('00', {max(0, (size or 0) - q - 32)})))" for i, (b, q, size) in enumerate(S.POOL_LAYOUTS.values())) + " ELSE unhex('00') END"
    return S.pool_accounts(t.part.selectExpr(f"{program} AS program", "concat('acc', p_partkey) AS account", f"{raw} AS raw"))


@query("derived_addresses")
def _(t):
    """The curve account of each mint: the first address off the curve, bumps from 255 down."""
    program = from_base58("6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P")

    def derive(batches):
        for frame in batches:
            frame["address"] = [to_base58(program_address([b"bonding-curve", int(k).to_bytes(32, "big")], program)) for k in frame.key]
            yield frame

    return t.supplier.select(F.col("s_suppkey").alias("key")).mapInPandas(derive, "key long, address string")


# Depth, cost, value
_STATE = "SELECT p_partkey AS id, p_size % 2 = 1 AS v3, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS stable, (1000 + p_size * 10) / 100.0 AS r0, (5000 + p_partkey) / 1000.0 AS r1, 1 + p_size % 5 AS k, 100000 + p_partkey AS l, p_size * 5.0 AS fee FROM part"


def pool_states(t):
    fee = f"CASE WHEN p_size % 2 = 1 THEN concat('0x', {word('p_size * 500')}) WHEN p_partkey % 2 = 0 THEN concat('0x', {word('0')}) END AS fee_word"
    return t.part.selectExpr("concat('p', p_partkey) AS pair_address", "CAST(2 AS DOUBLE) AS dec0", "CAST(3 AS DOUBLE) AS dec1", "CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS stable_idx", fee, f"concat('0x', {word('1000 + p_size * 10')}, {word('5000 + p_partkey')}) AS reserves", "concat('0x', lpad(concat(lower(hex(1 + p_size % 5)), repeat('0', 24)), 64, '0')) AS slot0", f"concat('0x', {word('100000 + p_partkey')}) AS liquidity")


@query("pool_depth", f"WITH s AS ({_STATE}), x AS (SELECT *, CASE WHEN v3 THEN l / CAST(k AS DOUBLE) / 100 ELSE r0 END AS x0, CASE WHEN v3 THEN l * k / 1000.0 ELSE r1 END AS x1, CASE WHEN stable IS NULL THEN 600.0 ELSE 1.0 END AS usd FROM s), y AS (SELECT *, CASE WHEN stable = 0 THEN x1 ELSE x0 END AS b, CASE WHEN stable = 0 THEN x0 ELSE x1 END AS q FROM x) SELECT 'p' || id AS pair_address, CASE WHEN v3 THEN 'v3' ELSE 'v2' END AS kind, CASE WHEN v3 THEN fee ELSE 25.0 END AS fee_bps, round(q / b * usd, 8) AS price_usd, round(2 * q * usd, 4) AS reserve_usd FROM y")
def _(t):
    x = S.pool_depth(pool_states(t), 600.0)
    return x.select("pair_address", "kind", F.round("fee_bps", 6).alias("fee_bps"), F.round("price_usd", 8).alias("price_usd"), F.round("reserve_usd", 4).alias("reserve_usd"))


_RP = "SELECT p_type AS token, p_brand || '-' || p_partkey AS pool, 1 + (p_partkey % 50) / 1000.0 AS mid, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 100 ELSE p_retailprice * 80 END AS reserve_usd, CASE WHEN p_partkey % 4 = 0 THEN 30.0 ELSE CAST(p_size % 4 * 5 + 5 AS DOUBLE) END AS fee_bps FROM part WHERE p_partkey % 19 <> 0"
_ROUTED = f"""WITH z(size) AS (VALUES (1000.0), (50000.0), (250000.0)), p AS (SELECT z.size, r.*, reserve_usd / 2 AS depth, mid / (1 - fee_bps / 10000.0) AS b FROM ({_RP}) r, z), y AS (SELECT *, sum(depth) OVER o AS r, sum(depth / b) OVER o AS q FROM p WINDOW o AS (PARTITION BY size, token ORDER BY b, pool)),
f AS (SELECT size, token, arg_max((size + r) / q, r) AS level FROM y WHERE (size + r) / q > b GROUP BY 1, 2), a AS (SELECT y.*, greatest(depth * (level / b - 1), 0) AS part FROM y JOIN f USING (size, token)), e AS (SELECT *, part / (reserve_usd / 2) AS imp, mid * (1 + size / (reserve_usd / 2)) / (1 - fee_bps / 10000.0) AS alone FROM a),
g AS (SELECT size, token, count(*) FILTER (WHERE part > 0) AS pools_used, sum(part) / sum(part / (mid * (1 + imp) / (1 - fee_bps / 10000.0))) AS price, sum(imp * part) / sum(part) AS impact, arg_max(mid, (reserve_usd, pool)) AS ref, arg_max(alone, (reserve_usd, pool)) AS alone, arg_max(reserve_usd, (reserve_usd, pool)) AS dr, arg_max(fee_bps, (reserve_usd, pool)) AS df FROM e GROUP BY 1, 2)
SELECT token, size AS size_usd, pools_used, round(price, 8) AS blended_price, round(impact, 8) AS blended_impact, round((price - ref) / ref, 8) AS total_cost, round((alone - ref) / ref - (price - ref) / ref, 8) AS saved, round(greatest(size / (dr / 2), 0.0002) + greatest(size / (dr / 2) / (1 + size / (dr / 2)), 0.0002) + 2 * df / 10000 + 2 * 0.2 / size, 8) AS single_pool_round_trip FROM g"""


@query("routed_cost_curve", _ROUTED)
def _(t):
    # reserves come whole or as one leg, fees given or known from the venue
    p = t.part.selectExpr("p_type AS token", "concat(p_brand, '-', p_partkey) AS pool", "CASE WHEN p_partkey % 19 <> 0 THEN 1 + (p_partkey % 50) / 1000.0D END AS price_usd", "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 100 END AS reserve_usd", "p_retailprice * 40 AS reserve_base_usd", "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size % 4 * 5 + 5 AS DOUBLE) END AS fee_bps", "'sushiswap' AS dex")
    return rounded(S.routed_cost_curve(S.routable(p), [1000.0, 50000.0, 250000.0]).select("token", "size_usd", "pools_used", "blended_price", "blended_impact", "total_cost", "saved", "single_pool_round_trip"), 8)


@query("backtest_frame", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY pair_address, ts ORDER BY seq) AS r FROM (SELECT pair_address, sec // 3600 AS ts, log_index AS seq, coalesce(price_usd, amount_usd) AS open, reserve_usd FROM trades)), f AS (SELECT pair_address, ts, open, coalesce(reserve_usd, 20000.0) AS reserve_usd FROM b WHERE r = 1) SELECT pair_address, ts, round(open, 6) AS open, reserve_usd, round(greatest(500 / (reserve_usd / 2), 0.0002) + greatest(500 / (reserve_usd / 2) / (1 + 500 / (reserve_usd / 2)), 0.0002) + 2 * 30 / 10000.0 + 2 * 0.3 / 500, 8) AS rt_cost_frac, round(lead(open) OVER (PARTITION BY pair_address ORDER BY ts), 6) AS fill_price FROM f")
def _(t):
    bars = t.trades.select("pair_address", F.floor(F.col("sec") / 3600).alias("ts"), F.col("log_index").alias("seq"), F.coalesce("price_usd", "amount_usd").alias("open"), "reserve_usd")
    x = S.backtest_frame(bars, 500.0, F.lit(30.0), F.lit(0.3), F.lit(20000.0), latency=1)
    return x.select("pair_address", "ts", F.round("open", 6).alias("open"), "reserve_usd", F.round("rt_cost_frac", 8).alias("rt_cost_frac"), F.round("fill_price", 6).alias("fill_price"))


@query("pool_valuation", "WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS base0, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 600.0 END AS usd, p_size % 3 = 1 AS native, CASE WHEN p_partkey % 4 = 0 THEN 3.0 END AS root, p_retailprice AS a0, p_size + 1.0 AS a1 FROM part), x AS (SELECT *, coalesce(CASE WHEN base0 THEN root * root ELSE 1 / (root * root) END, CASE WHEN base0 THEN a1 / a0 ELSE a0 / a1 END) AS price, CASE WHEN base0 THEN a1 ELSE a0 END AS q FROM p) SELECT p_partkey, round(price * usd, 8) AS price_usd, round(CASE WHEN native THEN price END, 8) AS price_native, round(2 * q * usd, 4) AS liquidity_usd, round(price * usd * 1000, 4) AS market_cap FROM x")
def _(t):
    quote = "CASE p_size % 3 WHEN 0 THEN 'usdt' WHEN 1 THEN 'wbnb' ELSE 'cake' END"
    p = t.part.selectExpr("p_partkey", f"CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE {quote} END AS token0", f"CASE WHEN p_partkey % 2 = 0 THEN {quote} ELSE 'T' END AS token1", "p_retailprice AS amount0", "p_size + 1.0D AS amount1", "CASE WHEN p_partkey % 4 = 0 THEN 3.0D END AS root")
    x = S.pool_value(p, F.lit("T"), ["usdt", "usdc"], "wbnb", 600.0, F.lit(1000.0))
    return x.select("p_partkey", F.round("price_usd", 8).alias("price_usd"), F.round("price_native", 8).alias("price_native"), F.round("liquidity_usd", 4).alias("liquidity_usd"), F.round("market_cap", 4).alias("market_cap"))


@query("lp_safety", "WITH h AS (SELECT o_custkey, sum(o_totalprice) AS s, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END) AS b, sum(CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 0 END) AS l FROM orders GROUP BY 1) SELECT o_custkey, round(b / s, 6) AS lp_burned_pct, round(l / s, 6) AS lp_locked_pct, b / s < 0.5 AND l / s < 0.5 AS unsafe FROM h WHERE s > 0")
def _(t):
    from pyspark.sql import Window

    held = t.orders.select(F.col("o_custkey").alias("pair_address"), F.when(F.col("o_orderkey") % 3 == 0, "dead").when(F.col("o_orderkey") % 3 == 1, "locker").otherwise("someone").alias("holder"), F.col("o_totalprice").alias("balance"), F.sum("o_totalprice").over(Window.partitionBy("o_custkey")).alias("supply"))
    x = S.lp_safety(held, ["dead"], {"locker": "L"})
    return rounded(x.select(F.col("pair_address").alias("o_custkey"), "lp_burned_pct", "lp_locked_pct", F.array_contains("flags", "LP not majority-burned/locked").alias("unsafe")))


@query("round_trip_tax", "WITH p AS (SELECT event_id, event_id % 7 = 0 AS reverted, CASE WHEN event_id % 14 = 0 THEN 0.0 ELSE value * 0.9 END AS bought, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS expected, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value * 0.4 END AS back, value * 0.5 AS want FROM events WHERE value > 0.01) SELECT event_id, CASE WHEN expected > 0 THEN reverted OR back = 0 END AS is_honeypot, round(CASE WHEN expected > 0 AND bought > 0 THEN greatest(0, 1 - bought / expected) END, 4) AS buy_tax, round(CASE WHEN expected <= 0 THEN NULL WHEN reverted THEN CASE WHEN bought > 0 THEN 1.0 END ELSE greatest(0, 1 - back / want) END, 4) AS sell_tax FROM p")
def _(t):
    p = t.events.where("value > 0.01").selectExpr("event_id", "event_id % 7 = 0 AS reverted", "CASE WHEN event_id % 14 = 0 THEN 0.0D ELSE value * 0.9D END AS bought", "CASE WHEN event_id % 11 = 0 THEN 0.0D ELSE value END AS expected", "CASE WHEN event_id % 5 = 0 THEN 0.0D ELSE value * 0.4D END AS back", "value * 0.5D AS expected_back")
    return S.round_trip_tax(p).select("event_id", "is_honeypot", F.round("buy_tax", 4).alias("buy_tax"), F.round("sell_tax", 4).alias("sell_tax"))


@query("owner_concentration", "WITH o AS (SELECT token, CAST(substr(dst, 2) AS BIGINT) % 40 AS owner, sum(value) AS b FROM transfers GROUP BY 1, 2 HAVING sum(value) <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY b DESC, owner) AS r, CASE WHEN token % 2 = 0 THEN 100000.0 ELSE CAST(sum(b) OVER (PARTITION BY token) AS DOUBLE) END AS t FROM o) SELECT token, count(*) AS holder_count, round(sum(CASE WHEN r <= 10 THEN b / t ELSE 0 END), 6) AS top10_pct, round(sum(CASE WHEN r <= 20 THEN b / t ELSE 0 END), 6) AS top20_pct, round(sum((b / t) * (b / t)), 6) AS hhi FROM r GROUP BY 1")
def _(t):
    """Holders by owner over their token accounts, against the supply where it is known."""
    accounts = t.transfers.select("token", (F.expr("try_cast(substring(dst, 2) as bigint)") % 40).alias("owner"), F.col("value").alias("amount"))
    known = F.when(F.col("token") % 2 == 0, 100000.0)
    return rounded(S.supply_concentration(S.owner_balances(accounts, ["token"]), ["token"], known))


@query("quote_anchor_as_of", "WITH p AS (SELECT pair_address, block_number, log_index, amount_usd FROM trades WHERE side = 'sell'), n AS (SELECT block_number, avg(price_usd) AS usd FROM trades WHERE side IS NULL AND price_usd IS NOT NULL GROUP BY 1) SELECT p.log_index, round(p.amount_usd * n.usd, 4) AS usd FROM p ASOF LEFT JOIN n ON n.block_number <= p.block_number")
def _(t):
    """A quote in native coin valued by the native price known at the trade's block, not by today's."""
    from ammlytics.functions.rolling import as_of

    p = t.trades.where("side = 'sell'").select(F.lit(0).alias("k"), "block_number", "log_index", "amount_usd")
    n = t.trades.where("side is null and price_usd is not null").groupBy("block_number").agg(F.avg("price_usd").alias("usd")).withColumn("k", F.lit(0))
    # the native price is one short series: a row a block, joined to each distinct block, not to each trade
    at = as_of(p.select("k", "block_number").distinct(), n, ["k"], "block_number", "block_number", "usd")
    return p.join(at.select("block_number", "usd_as_of"), "block_number").select("log_index", F.round(F.col("amount_usd") * F.col("usd_as_of"), 4).alias("usd"))


@query("mint_decimals", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 9 ELSE p_size % 10 END AS decimals, round(p_retailprice / power(10, CASE WHEN p_size % 3 = 0 THEN 9 ELSE p_size % 10 END), 12) AS amount FROM part")
def _(t):
    """Decimals of mints from their accounts, 9 where an account says nothing, applied to raw amounts."""
    dim = t.part.where("p_size % 3 <> 0").select("p_partkey", (F.col("p_size") % 10).alias("d"))
    x = t.part.select("p_partkey", "p_retailprice").join(dim, "p_partkey", "left")
    d = F.coalesce("d", F.lit(9))
    return x.select("p_partkey", d.alias("decimals"), F.round(F.col("p_retailprice") / F.pow(F.lit(10.0), d), 12).alias("amount"))


@query("pools_of_creations", "SELECT count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part WHERE p_partkey % 9 <> 0 AND p_size % 3 <> 2 AND (p_size = 7 OR p_partkey = 7)")
def _(t):
    """Creations that name one token on either side."""
    topic = lambda x: f"concat('0x', {word(x)})"
    logs = t.part.selectExpr("CASE p_size % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v3' ELSE 'launchpad' END AS kind", "p_partkey AS block_number", f"array('0x00', {topic('p_partkey')}, {topic('p_size')}, {topic('p_size * 500')}) AS topics", f"CASE WHEN p_partkey % 9 = 0 THEN '0x12' ELSE concat('0x', {word('5')}, {word('p_partkey + 1000')}) END AS data")
    return S.pools_with_token(logs, "0x" + f"{7:040x}").agg(F.count("*").alias("n"), F.min("block_number").alias("first"), F.max("block_number").alias("last"))
