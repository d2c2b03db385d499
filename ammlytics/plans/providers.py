"""Queries over landed responses: each stand-in table lands as JSON texts, the normaliser reads them, and the SQL says what has to come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.operators import normalise as N
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query


def landed(df, keep: list[str], body: str):
    """Rows as JSON texts: the kept expressions and ``body``, a struct as SQL."""
    return df.selectExpr(*keep, f"to_json({body}) AS body")


_CHAIN = "CASE p_size % 3 WHEN 0 THEN 'bsc' WHEN 1 THEN 'solana' ELSE 'ether' END"
_PAIR = """named_struct('chainId', CASE p_size % 3 WHEN 0 THEN 'bsc' WHEN 1 THEN 'SOLANA' ELSE 'ether' END, 'dexId', p_brand, 'pairAddress', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('P', p_partkey) END,
 'baseToken', named_struct('address', concat('T', p_partkey % 40), 'symbol', concat('s', p_partkey % 40)), 'quoteToken', named_struct('address', 'Q', 'symbol', 'q'), 'priceUsd', CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS STRING) END,
 'liquidity', CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE named_struct('usd', p_retailprice * 10) END, 'volume', named_struct('h1', p_size, 'h24', p_size * 24), 'priceChange', named_struct('h24', p_size % 9 - 4),
 'txns', named_struct('h24', named_struct('buys', p_size, 'sells', p_size + 1)), 'marketCap', p_retailprice * 1000, 'pairCreatedAt', 1700000000999 + p_partkey * 1000)"""
_PAIRS = f"""pairs AS (SELECT p_partkey, {_CHAIN} AS chain, 'P' || p_partkey AS pair_address, 'T' || p_partkey % 40 AS base_address, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price_usd, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 10 END AS liquidity_usd,
 CAST(p_size * 24 AS DOUBLE) AS volume_24h, p_size, 1700000000 + p_partkey AS created_sec, p_retailprice * 1000 AS market_cap FROM part WHERE p_partkey % 11 <> 0 AND p_size % 3 < 2)"""


def pair_rows(t):
    return N.pair_pools(landed(t.part, ["p_partkey"], _PAIR))


@query("pair_list_pools", f"WITH {_PAIRS} SELECT p_partkey, chain, pair_address, base_address, round(price_usd, 6) AS price_usd, round(liquidity_usd, 6) AS liquidity_usd, volume_24h, CAST(p_size AS BIGINT) AS txns_24h_buys, CAST(p_size + 1 AS BIGINT) AS txns_24h_sells, CAST(p_size % 9 - 4 AS DOUBLE) AS price_change_24h, CAST(created_sec AS BIGINT) AS created_sec FROM pairs")
def _(t):
    return rounded(pair_rows(t).select("p_partkey", "chain", "pair_address", "base_address", "price_usd", "liquidity_usd", "volume_24h", "txns_24h_buys", "txns_24h_sells", "price_change_24h", "created_sec"))


_TOKENS = "k AS (SELECT *, CASE WHEN chain = 'bsc' THEN lower(base_address) ELSE base_address END AS address, row_number() OVER (PARTITION BY chain, base_address ORDER BY coalesce(liquidity_usd, 0) DESC, pair_address DESC) AS r FROM pairs)"


@query("pair_list_tokens", f"WITH {_PAIRS}, {_TOKENS} SELECT chain, address, round(max(price_usd) FILTER (WHERE r = 1), 6) AS price_usd, max(pair_address) FILTER (WHERE r = 1) AS deepest_pool, round(sum(coalesce(liquidity_usd, 0)), 4) AS liquidity_usd, sum(volume_24h) AS volume_24h, count(*) AS pair_count, CAST(min(created_sec) AS BIGINT) AS created_sec FROM k GROUP BY 1, 2")
def _(t):
    x = N.tokens_of_pools(pair_rows(t)).select("chain", "address", F.round("price_usd", 6).alias("price_usd"), "deepest_pool", F.round("liquidity_usd", 4).alias("liquidity_usd"), "volume_24h", "pair_count", "created_sec")
    return x


@query("new_pairs_of_profiles", f"WITH {_PAIRS}, f AS (SELECT DISTINCT 'T' || s_suppkey % 60 AS token, CASE s_nationkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain FROM supplier) SELECT pairs.chain, pair_address, base_address FROM pairs SEMI JOIN f ON f.token = base_address AND f.chain = pairs.chain")
def _(t):
    """Pools of the tokens that have a profile on the same chain."""
    profiles = N.parsed(landed(t.supplier, ["s_suppkey"], "named_struct('chainId', CASE s_nationkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END, 'tokenAddress', concat('T', s_suppkey % 60))"), "chainId STRING, tokenAddress STRING")
    p = profiles.select(N.known_chain(F.col("m.chainId")).alias("chain"), F.col("m.tokenAddress").alias("base_address")).distinct()
    return pair_rows(t).join(p, ["chain", "base_address"], "left_semi").select("chain", "pair_address", "base_address")


_LISTED = """named_struct('attributes', named_struct('address', CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('L', p_partkey) END, 'base_token_price_usd', CAST(p_retailprice AS STRING), 'reserve_in_usd', CAST(p_retailprice * 7 AS STRING), 'volume_usd', named_struct('h24', p_size),
 'transactions', named_struct('h24', named_struct('buys', p_size)), 'pool_created_at', CASE WHEN p_partkey % 4 = 0 THEN 'soon' ELSE concat('2024-01-0', 1 + p_partkey % 9, 'T00:00:0', p_partkey % 10, 'Z') END),
 'relationships', named_struct('base_token', named_struct('data', named_struct('id', concat(CASE p_size % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END, '_B', p_partkey % 30))), 'quote_token', named_struct('data', named_struct('id', 'bsc_Q')), 'dex', named_struct('data', named_struct('id', p_brand))))"""


@query("listed_pools", "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain, p_brand AS dex, 'L' || p_partkey AS pair_address, 'B' || p_partkey % 30 AS base_address, 'Q' AS quote_address, round(p_retailprice, 6) AS price_usd, round(p_retailprice * 7, 6) AS liquidity_usd, CAST(p_size AS DOUBLE) AS volume_24h, CASE WHEN p_partkey % 4 <> 0 THEN 1704067200 + 86400 * (p_partkey % 9) + p_partkey % 10 END AS created_sec FROM part WHERE p_partkey % 13 <> 0")
def _(t):
    return rounded(N.listed_pools(landed(t.part, ["p_partkey"], _LISTED)).select("p_partkey", "chain", "dex", "pair_address", "base_address", "quote_address", "price_usd", "liquidity_usd", "volume_24h", "created_sec"))


@query("listed_tokens", "WITH l AS (SELECT CASE p_size % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS chain, CASE p_size % 2 WHEN 0 THEN 'b' ELSE 'B' END || p_partkey % 30 AS address, 'L' || p_partkey AS pool, p_retailprice * 7 AS liq, p_size AS v FROM part WHERE p_partkey % 13 <> 0) SELECT chain, address, arg_max(pool, (liq, pool)) AS deepest_pool, round(sum(liq), 4) AS liquidity_usd, CAST(sum(v) AS DOUBLE) AS volume_24h, count(*) AS pair_count FROM l GROUP BY 1, 2")
def _(t):
    return N.tokens_of_pools(N.listed_pools(landed(t.part, ["p_partkey"], _LISTED))).select("chain", "address", "deepest_pool", F.round("liquidity_usd", 4).alias("liquidity_usd"), "volume_24h", "pair_count")


@query("token_overviews", "SELECT c_custkey, 't' || c_custkey AS symbol, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 18 END AS decimals, CASE c_custkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 2000.0 END AS total_supply, round(c_acctbal, 4) AS price_usd, round(c_acctbal * CASE c_custkey % 2 WHEN 0 THEN 10 ELSE 20 END, 4) AS market_cap, CAST(c_custkey % 100 AS BIGINT) AS holder_count FROM customer")
def _(t):
    body = "named_struct('symbol', concat('t', c_custkey), 'decimals', CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 18 AS STRING) ELSE 'many' END, 'totalSupply', CASE c_custkey % 3 WHEN 0 THEN 1000 END, 'circulatingSupply', CASE c_custkey % 3 WHEN 1 THEN 2000 END, 'price', c_acctbal, 'marketCap', CASE c_custkey % 2 WHEN 0 THEN c_acctbal * 10 END, 'mc', c_acctbal * 20, 'holders', c_custkey % 100)"
    return rounded(N.token_overview(landed(t.customer, ["c_custkey"], body)).select("c_custkey", "symbol", "decimals", "total_supply", "price_usd", "market_cap", "holder_count"), 4)


# Bars
@query("listed_ohlcv", "SELECT o_orderkey, 1700000000 + o_orderkey * 60 + k AS sec, o_totalprice + k AS open, o_totalprice + k + 1 AS high, o_totalprice AS low, o_totalprice + 2 * k AS close, CAST(k AS DOUBLE) AS volume FROM orders, range(0, 3) g(k) WHERE (o_orderkey + k) % 5 <> 0")
def _(t):
    bar = "transform(sequence(0, 2), k -> array(CAST(1700000000 + o_orderkey * 60 + k AS STRING), CAST(o_totalprice + k AS STRING), CAST(o_totalprice + k + 1 AS STRING), CASE WHEN (o_orderkey + k) % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END, CAST(o_totalprice + 2 * k AS STRING), CAST(k AS STRING)))"
    return N.listed_bars(landed(t.orders, ["o_orderkey"], bar))


@query("paged_ohlcv", "WITH i AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS sec, event_id // 50 AS page, min(event_id) AS e FROM events GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, sec ORDER BY page) AS k FROM i), b AS (SELECT f.user_id, sec, value FROM f JOIN events ON e = event_id WHERE k = 1 AND e % 9 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC) AS r FROM b) SELECT user_id, sec, round(value, 6) AS open, round(value + 1, 6) AS close FROM n WHERE r <= 20")
def _(t):
    # one bar a user, hour and page; pages overlap
    first = t.events.selectExpr("user_id", "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('HOUR', ts)) AS sec", "event_id div 50 AS page", "event_id", "value").groupBy("user_id", "sec", "page").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e"))
    body = "named_struct('unixTime', CASE WHEN sec % 2 = 0 THEN sec END, 'unix_time', sec, 'o', CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE e.value END, 'high', e.value + 2, 'l', e.value - 1, 'c', e.value + 1, 'v', 1)"
    return rounded(N.paged_bars(landed(first, ["user_id", "page"], body), "user_id", 20, "page").select("user_id", "sec", "open", "close"))


@query("aggregated_ohlcv", "SELECT p_partkey, 1704067200 + 60 * (p_partkey % 60) AS sec, p_retailprice AS open, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_retailprice + 5 END AS high, p_retailprice + 1 AS close, CAST(p_size AS BIGINT) AS trade_count FROM part WHERE p_partkey % 10 <> 0")
def _(t):
    body = "named_struct('Block', named_struct('Timefield', concat('2024-01-01T00:', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'), ':00Z')), 'Trade', named_struct('open', p_retailprice, 'close', CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice + 1 END, 'high', CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice + 5 END), 'volume', '12', 'count', p_size)"
    return N.aggregated_bars(landed(t.part, ["p_partkey"], body)).select("p_partkey", "sec", "open", "high", "close", "trade_count")


# Trades
@query("leg_trades", "SELECT event_id, 1700000000 + event_id AS sec, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side, round(CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END, 6) AS amount_base, round(CASE WHEN event_id % 3 = 0 THEN value ELSE value * 2 END, 6) AS amount_quote, 'm' || user_id AS maker FROM events")
def _(t):
    body = """named_struct('from', named_struct('address', CASE WHEN event_id % 3 = 0 THEN 'OTHER' ELSE 'Tok' END, 'uiAmount', value), 'to', named_struct('address', CASE WHEN event_id % 3 = 0 THEN 'TOK' ELSE 'OTHER' END, 'amount', value * 2),
 'side', CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' ELSE 'Sell' END END, 'txType', CASE WHEN event_id % 4 > 1 THEN CASE WHEN event_type IN ('purchase', 'signup') THEN 'add' ELSE 'remove' END END, 'unixTime', 1700000000 + event_id, 'owner', concat('m', user_id))"""
    return rounded(N.leg_trades(landed(t.events, ["event_id"], body), F.lit("tok")).select("event_id", "sec", "side", "amount_base", "amount_quote", "maker"))


@query("kind_trades", "SELECT event_id, event_type AS side, round(CASE WHEN event_type = 'buy' THEN value ELSE value * 3 END, 6) AS price_usd, round(CASE WHEN event_type = 'buy' THEN value + 1 ELSE value + 2 END, 6) AS amount_base FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS event_type, value FROM events WHERE event_id % 6 <> 0)")
def _(t):
    body = "named_struct('attributes', named_struct('block_timestamp', CASE WHEN event_id % 6 = 0 THEN 'never' ELSE '2024-05-01T10:00:00Z' END, 'kind', CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END, 'to_token_amount', value + 1, 'from_token_amount', value + 2, 'price_to_in_usd', value, 'price_from_in_usd', value * 3, 'volume_in_usd', '1'))"
    return rounded(N.kind_trades(landed(t.events, ["event_id"], body)).select("event_id", "side", "price_usd", "amount_base"))


@query("graph_trades", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side, round(CASE event_id % 3 WHEN 1 THEN value * 2 ELSE value END, 6) AS amount_base, round(CASE event_id % 3 WHEN 1 THEN value * 2 * 7 ELSE value * 5 END, 6) AS amount_usd, CASE WHEN event_id % 2 = 0 THEN 'b' || user_id ELSE 'f' || user_id END AS maker FROM events")
def _(t):
    body = "named_struct('Block', named_struct('Time', '2024-05-01T10:00:00Z'), 'Transaction', named_struct('From', concat('f', user_id)), 'Trade', named_struct('Buy', named_struct('Buyer', CASE WHEN event_id % 2 = 0 THEN concat('b', user_id) END, 'Currency', named_struct('SmartContract', CASE event_id % 3 WHEN 0 THEN '0xBASE' ELSE '0xother' END), 'Amount', value, 'PriceInUSD', 5), 'Sell', named_struct('Currency', named_struct('SmartContract', CASE event_id % 3 WHEN 1 THEN '0xbase' ELSE '0xother' END), 'Amount', value * 2, 'PriceInUSD', 7)))"
    return rounded(N.graph_trades(landed(t.events, ["event_id"], body), F.lit("0xBase")).select("event_id", "side", "amount_base", "amount_usd", "maker"))


# Launches
@query("launch_feeds", "SELECT c_custkey, 'mint' || c_custkey AS address, CASE WHEN c_custkey % 5 = 0 THEN 1.0 WHEN c_custkey % 5 = 1 THEN NULL ELSE round((c_custkey % 101) / CASE WHEN c_custkey % 101 > 1 THEN 100.0 ELSE 1 END, 6) END AS progress, CASE WHEN c_custkey % 5 = 0 THEN true END AS complete, CASE WHEN c_custkey % 5 = 0 THEN 1704067200 END AS graduated_sec, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 20000 ELSE 7 END, 4) AS market_cap_usd FROM customer")
def _(t):
    body = "named_struct('tokenAddress', CASE WHEN c_custkey % 2 = 0 THEN concat('mint', c_custkey) END, 'mint', concat('mint', c_custkey), 'fullyDilutedValuation', CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 20000 ELSE 0 END, 'marketCap', 7, 'bondingCurveProgress', CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey % 101 AS STRING) WHEN c_custkey % 5 = 1 THEN '?' END, 'bondingProgress', CASE WHEN c_custkey % 5 > 1 THEN c_custkey % 101 END, 'graduatedAt', '2024-01-01T00:00:00Z')"
    x = N.launch_feed(landed(t.customer, ["c_custkey"], body), F.col("c_custkey") % 5 == 0)
    return rounded(x.select("c_custkey", "address", F.round("bonding_curve_progress", 6).alias("progress"), "complete", "graduated_sec", "market_cap_usd"), 6)


@query("curve_launches", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN round(least(greatest(1 - (p_retailprice * 1000000 - 206900000) / 793100000.0, 0), 1), 6) END AS progress, (p_partkey % 4 <> 1 AND p_retailprice * 1000000 <= 206900000) OR p_partkey % 6 = 0 AS complete, CASE WHEN p_partkey % 6 = 0 THEN 1704153600 END AS graduated_sec, CASE WHEN p_partkey % 4 <> 2 THEN 'by' || p_size END AS creator FROM part WHERE p_partkey % 4 <> 3")
def _(t):
    body = "named_struct('create', CASE WHEN p_partkey % 4 IN (0, 1) THEN named_struct('time', '2024-01-01T00:00:00Z', 'signer', concat('by', p_size), 'name', p_name) END, 'pool', CASE WHEN p_partkey % 4 IN (0, 2) THEN named_struct('base', p_retailprice * 1000000, 'quote_usd', 5) END, 'migrate', array(named_struct('time', '2024-01-02T00:00:00Z', 'mints', array('x', CASE WHEN p_partkey % 6 = 0 THEN concat('M', p_partkey) ELSE 'y' END))))"
    x = N.curve_launches(landed(t.part, ["p_partkey"], body), F.concat(F.lit("M"), F.col("p_partkey").cast("string")))
    return x.select("p_partkey", F.round("bonding_curve_progress", 6).alias("progress"), "complete", "graduated_sec", "creator")


# Safety
@query("contract_safety", "SELECT p_partkey, p_size % 2 = 1 AS is_honeypot, p_size / 100.0 AS sell_tax, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ownership_renounced, round((10 * p_size + 45) / 1000.0, 6) AS top10_holder_pct, 0.25 AS lp_locked_pct, CASE WHEN p_partkey % 2 = 0 THEN 0.75 ELSE 0.5 END AS lp_burned_pct, concat_ws(';', CASE WHEN p_size % 2 = 1 THEN 'honeypot' END, CASE WHEN p_size % 3 = 0 THEN 'mintable' END, CASE WHEN p_size % 5 = 0 THEN 'proxy contract' END, CASE WHEN p_size % 7 = 0 THEN 'not open source' END) AS flags FROM part")
def _(t):
    body = """named_struct('is_honeypot', CASE WHEN p_size % 2 = 1 THEN '1' ELSE '0' END, 'is_mintable', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE '' END, 'is_proxy', CASE WHEN p_size % 5 = 0 THEN '1' END, 'is_open_source', CASE WHEN p_size % 7 = 0 THEN '0' ELSE '1' END, 'sell_tax', CAST(p_size / 100.0D AS STRING),
 'owner_address', CASE p_partkey % 3 WHEN 0 THEN ' 0x000000000000000000000000000000000000DEAD' WHEN 1 THEN '0xabc' END, 'holders', transform(sequence(0, 11), i -> named_struct('percent', CAST((p_size + i) / 1000.0D AS STRING))),
 'lp_holders', array(named_struct('address', '0x0000000000000000000000000000000000000000', 'percent', '0.5', 'is_locked', '0', 'tag', ''), named_struct('address', '0x1', 'percent', '0.25', 'is_locked', '1', 'tag', CASE WHEN p_partkey % 2 = 0 THEN 'Burner' ELSE 'x' END)))"""
    x = N.contract_safety(landed(t.part, ["p_partkey"], body))
    return rounded(x.select("p_partkey", "is_honeypot", "sell_tax", "ownership_renounced", "top10_holder_pct", "lp_locked_pct", "lp_burned_pct", F.array_join("flags", ";").alias("flags")))


@query("mint_safety", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mint_authority_active, CASE WHEN p_size % 4 = 0 THEN 0.025 WHEN p_size % 4 = 1 THEN 0.5 END AS transfer_tax, CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.4 END AS lp_burned_pct, concat_ws(';', CASE WHEN p_size % 3 = 0 THEN 'mint authority active' END, CASE WHEN p_size % 5 = 0 THEN 'transfer hook' END, CASE WHEN p_size % 4 < 2 THEN 'transfer fee' END, CASE WHEN p_size % 7 = 0 THEN 'malicious creator' END) AS flags FROM part")
def _(t):
    body = """named_struct('mintable', CASE p_size % 3 WHEN 0 THEN named_struct('status', '1') WHEN 1 THEN named_struct('status', '0') END, 'transfer_fee', CASE p_size % 4 WHEN 0 THEN named_struct('fee_rate', '250', 'pct', NULL) WHEN 1 THEN named_struct('fee_rate', NULL, 'pct', '0.5') END,
 'transfer_hook', CASE WHEN p_size % 5 = 0 THEN array('h') ELSE array() END, 'creators', array(named_struct('malicious_address', '0'), named_struct('malicious_address', CASE WHEN p_size % 7 = 0 THEN '1' END)), 'dex', array(named_struct('burn_percent', '40'), named_struct('burn_percent', CASE WHEN p_size % 2 = 0 THEN '0.9' END)))"""
    x = N.mint_safety(landed(t.part, ["p_partkey"], body))
    return x.select("p_partkey", "mint_authority_active", "transfer_tax", "lp_burned_pct", F.array_join("flags", ";").alias("flags"))


@query("report_safety", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mint_authority_active, round((10 * p_size + 45) / 10000.0, 6) AS top10_holder_pct, CASE WHEN p_size % 2 = 0 THEN 0.95 ELSE 0.5 END AS lp_locked_pct, 0.03 AS transfer_tax, 'a;b' || p_size AS flags FROM part")
def _(t):
    body = "named_struct('topHolders', transform(sequence(0, 14), i -> named_struct('pct', (p_size + i) / 100.0D)), 'markets', array(named_struct('lp', named_struct('lpLockedPct', 50)), named_struct('lp', named_struct('lpLockedPct', CASE WHEN p_size % 2 = 0 THEN 95 END))), 'transferFee', named_struct('pct', 3), 'risks', array(named_struct('name', 'a'), named_struct('name', concat('b', p_size))))"
    # to_json leaves nulls out; the authority's key is there with null (revoked) or missing
    key = "CASE p_size % 3 WHEN 0 THEN '{\"mintAuthority\": \"k\", ' WHEN 1 THEN '{\"mintAuthority\": null, ' ELSE '{' END"
    x = t.part.selectExpr("p_partkey", f"concat({key}, substring(to_json({body}), 2)) AS body")
    return rounded(N.report_safety(x).select("p_partkey", "mint_authority_active", "top10_holder_pct", "lp_locked_pct", "transfer_tax", F.array_join("flags", ";").alias("flags")))


@query("simulated_safety", "SELECT s_suppkey, s_suppkey % 2 = 0 AS is_honeypot, round(s_suppkey / 100.0, 6) AS buy_tax, CASE WHEN s_suppkey % 3 = 1 THEN 'x;why' ELSE 'why' END AS flags FROM supplier")
def _(t):
    body = "named_struct('summary', named_struct('flags', CASE s_suppkey % 3 WHEN 0 THEN array('why') WHEN 1 THEN array('x') END), 'honeypotResult', named_struct('isHoneypot', s_suppkey % 2 = 0, 'honeypotReason', 'why'), 'simulationResult', named_struct('buyTax', s_suppkey))"
    return rounded(N.simulated_safety(landed(t.supplier, ["s_suppkey"], body)).select("s_suppkey", "is_honeypot", "buy_tax", F.array_join("flags", ";").alias("flags")))


@query("mint_account_safety", "SELECT c_custkey, c_custkey * 10.0 AS total_supply, c_custkey % 2 = 0 AS mint_authority_active, round((10 * (c_custkey % 50) + 45) / (c_custkey * 10.0), 6) AS top10_holder_pct, CASE WHEN (10 * (c_custkey % 50) + 45) / (c_custkey * 10.0) > 0.5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'mint authority active;top10 hold >50%' ELSE 'top10 hold >50%' END WHEN c_custkey % 2 = 0 THEN 'mint authority active' ELSE '' END AS flags FROM customer WHERE c_custkey > 0")
def _(t):
    body = "named_struct('info', named_struct('decimals', 6, 'supply', CAST(c_custkey * 10000000 AS STRING), 'mintAuthority', CASE WHEN c_custkey % 2 = 0 THEN 'a' END), 'largest', transform(sequence(0, 19), i -> named_struct('uiAmount', c_custkey % 50 + i)))"
    return rounded(N.mint_account_safety(landed(t.customer.where("c_custkey > 0"), ["c_custkey"], body)).select("c_custkey", "total_supply", "mint_authority_active", "top10_holder_pct", F.array_join("flags", ";").alias("flags")))


@query("owner_safety", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ownership_renounced, CASE WHEN s_suppkey % 3 = 1 THEN 'ownership not renounced' ELSE '' END AS flags FROM supplier")
def _(t):
    hexed = "CASE s_suppkey % 3 WHEN 0 THEN concat('0x', repeat('0', 60), 'dEaD') WHEN 1 THEN concat('0x', lpad(lower(hex(s_suppkey)), 64, '0')) ELSE '0x' END AS owner_hex"
    return N.owner_safety(t.supplier.selectExpr("s_suppkey", hexed)).select("s_suppkey", "ownership_renounced", F.array_join("flags", ";").alias("flags"))


# Listings
_VENUE = "CASE p_size % 5 WHEN 0 THEN 'binance' WHEN 1 THEN 'uniswap_v3' WHEN 2 THEN 'kraken' WHEN 3 THEN 'sushiswap' ELSE 'gate' END"


@query("venue_listings", f"WITH x AS (SELECT p_type AS coin, {_VENUE} AS id, p_brand AS base, p_partkey % 3 AS page, p_partkey AS pos, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE upper({_VENUE}) || p_partkey % 2 END AS name FROM part), o AS (SELECT coin, id, base, arg_min(name, page * 1000000 + pos) AS name FROM x GROUP BY 1, 2, 3) SELECT coin, count(*) AS tickers, coalesce(string_agg(DISTINCT name, ';' ORDER BY name) FILTER (WHERE NOT id LIKE '%swap%'), '') AS cex, coalesce(string_agg(DISTINCT name, ';' ORDER BY name) FILTER (WHERE id LIKE '%swap%'), '') AS dex FROM o WHERE name <> '' GROUP BY 1")
def _(t):
    x = t.part.selectExpr("p_type AS coin", "p_partkey % 3 AS page", "p_partkey AS pos", f"{_VENUE} AS identifier", f"CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(upper({_VENUE}), p_partkey % 2) END AS name", "p_brand AS base", "'usd' AS target")
    g = N.listings(x, "coin")
    return g.select("coin", "tickers", F.array_join("cex", ";").alias("cex"), F.array_join("dex", ";").alias("dex"))


# One token by several sources: a source without an answer adds nothing, fields and votes are merged in order of the sources
@query("merged_sources", "SELECT user_id, coalesce(min(value) FILTER (WHERE event_type = 'purchase' AND k = 1), min(value) FILTER (WHERE event_type = 'view' AND k = 1), min(value) FILTER (WHERE event_type = 'click' AND k = 1)) AS price, max(value) FILTER (WHERE event_type IN ('purchase', 'view', 'click')) AS worst, string_agg(DISTINCT CASE event_type WHEN 'purchase' THEN 'a' WHEN 'view' THEN 'b' WHEN 'click' THEN 'c' END, '+' ORDER BY CASE event_type WHEN 'purchase' THEN 'a' WHEN 'view' THEN 'b' WHEN 'click' THEN 'c' END) AS source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1")
def _(t):
    ranked = [("a", "purchase"), ("b", "view"), ("c", "click")]
    parts = [t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.lit(i).alias("rank"), F.lit(name).alias("source"), F.min_by("value", "event_id").alias("price"), F.max("value").alias("worst")) for i, (name, kind) in enumerate(ranked)]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.min_by("price", F.when(F.col("price").isNotNull(), F.col("rank")))
    return x.groupBy("user_id").agg(first.alias("price"), F.max("worst").alias("worst"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]), "+").alias("source"))


@query("holder_source_order", "WITH a AS (SELECT 'pool' || o_custkey AS address, o_orderkey AS seq, o_orderkey % 1000 AS n FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 3 = 0), b AS (SELECT 'pool' || c_custkey AS address, c_custkey AS seq, c_custkey AS n FROM customer), u AS (SELECT address, 0 AS rank, seq, n FROM a UNION ALL SELECT address, 1, seq, n FROM b), f AS (SELECT *, min(rank) OVER (PARTITION BY address) AS best FROM u) SELECT address, seq, n FROM f WHERE rank = best")
def _(t):
    """Counts over time from the first source that has any for the address."""
    a = t.holders.where("holder_count is not null and cast(substring(address, 5) as bigint) % 3 = 0").select("address", F.lit(0).alias("rank"), "seq", F.col("holder_count").alias("n"))
    b = t.customer.select(F.concat(F.lit("pool"), F.col("c_custkey").cast("string")).alias("address"), F.lit(1).alias("rank"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("n"))
    u = a.unionByName(b).withColumn("best", F.min("rank").over(Window.partitionBy("address")))
    return u.where("rank = best").select("address", "seq", "n")


@query("json_safe", "SELECT p_partkey, '{\"at\":\"2024-01-01T00:00:00Z\",' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '\"v\":' || p_size || '.0,' END || '\"raw\":\"' || lower(hex(p_brand)) || '\"}' AS body FROM part")
def _(t):
    v = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    x = t.part.select("p_partkey", F.timestamp_seconds(F.lit(1704067200)).alias("at"), v.alias("v"), F.encode("p_brand", "utf-8").alias("raw"))
    return N.as_json(x, ["p_partkey"])
