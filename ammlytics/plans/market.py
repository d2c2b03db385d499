"""Queries over the trade tape and its dimensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions.ordered import quantiles
from ammlytics.operators import market as M
from ammlytics.plans.registry import query


def rounded(df, digits: int = 6):
    """Doubles rounded to a fixed scale, floats of either engine being equal then."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_LAST = "arg_max({0}, sec * 1000000000 + block_number * 100000000 + log_index) FILTER (WHERE {0} IS NOT NULL)"
_SCREEN = f"""
SELECT t.chain, t.pair_address, min(t.dex) AS dex, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS n_trades, sum(coalesce(amount_usd, 0)) AS volume_usd,
 coalesce(sum(amount_usd) FILTER (WHERE side = 'buy'), 0) AS buy_usd, coalesce(sum(amount_usd) FILTER (WHERE side = 'sell'), 0) AS sell_usd,
 count(*) FILTER (WHERE side = 'buy') AS n_buys, count(*) FILTER (WHERE side = 'sell') AS n_sells, {_LAST.format('price_usd')} AS last_price, {_LAST.format('reserve_usd')} AS liquidity_usd
FROM trades t GROUP BY t.chain, t.pair_address"""
_FULL = f"""WITH a AS ({_SCREEN}),
u AS (SELECT chain, pair_address, min(created_sec) AS created_sec FROM pool_universe GROUP BY 1, 2),
h AS (SELECT chain, address, arg_max(holder_count, (observed_at, seq)) FILTER (WHERE holder_count IS NOT NULL) AS holder_count FROM holders GROUP BY 1, 2)
SELECT a.chain, a.pair_address, a.dex, first_sec, last_sec, n_trades, round(volume_usd, 6) AS volume_usd, round(buy_usd, 6) AS buy_usd, round(sell_usd, 6) AS sell_usd, n_buys, n_sells, round(last_price, 6) AS last_price, liquidity_usd,
 u.created_sec, CAST(last_sec // 86400 - coalesce(u.created_sec, first_sec) // 86400 AS BIGINT) AS age_days, CAST(h.holder_count AS BIGINT) AS holder_count
FROM a LEFT JOIN u USING (chain, pair_address) LEFT JOIN h ON h.chain = a.chain AND h.address = a.pair_address"""


@query("screener", _FULL + " ORDER BY volume_usd DESC NULLS LAST, a.chain, a.pair_address LIMIT 100")
def _(t):
    return rounded(M.screener(t.trades, t.pool_universe, t.holders))


@query("screener_filtered", _FULL + " WHERE volume_usd >= 5000 AND liquidity_usd >= 12000 AND a.dex = 'dex1' ORDER BY age_days ASC NULLS LAST, a.chain, a.pair_address LIMIT 20")
def _(t):
    return rounded(M.screener(t.trades, t.pool_universe, t.holders, min_volume=5000, min_liquidity=12000, dex="dex1", order_by="age_days", descending=False, limit=20))


@query("screener_text", f"WITH a AS ({_SCREEN}) SELECT chain, pair_address, dex, round(buy_usd, 6) AS buy_usd, round(sell_usd, 6) AS sell_usd, round(100 * buy_usd / nullif(buy_usd + sell_usd, 0)) AS buy_share FROM a WHERE contains(lower(concat_ws(' ', pair_address, dex, chain)), 'ool1')")
def _(t):
    return rounded(M.text_screen(M.screener(t.trades, limit=None), "OOL1").select("chain", "pair_address", "dex", "buy_usd", "sell_usd", "buy_share"))


@query("top_tokens", "SELECT chain, pair_address, round(sum(coalesce(amount_usd, 0)), 6) AS volume_usd, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'buy'), 0), 6) AS buy_usd, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'sell'), 0), 6) AS sell_usd, count(*) AS n_trades FROM trades WHERE chain = 'bsc' AND sec >= 1704500000 GROUP BY 1, 2 ORDER BY volume_usd DESC, pair_address LIMIT 25")
def _(t):
    return rounded(M.top_tokens(t.trades, "bsc", 1704500000))


@query("pair_stub", "SELECT pair_address, count(*) AS n_trades, round(sum(coalesce(amount_usd, 0)), 6) AS volume_usd, round(" + _LAST.format("price_usd") + ", 6) AS last_price, max(sec) AS last_sec FROM trades WHERE pair_address = 'pool7' GROUP BY 1")
def _(t):
    rows = t.trades.where("pair_address = 'pool7'")
    return rounded(rows.groupBy("pair_address").agg(F.count("*").alias("n_trades"), F.sum(F.coalesce("amount_usd", F.lit(0.0))).alias("volume_usd"), M.latest("price_usd", "sec", "block_number", "log_index").alias("last_price"), F.max("sec").alias("last_sec")))


@query("latest_holders", "SELECT chain, address, CAST(arg_max(holder_count, (observed_at, seq)) FILTER (WHERE holder_count IS NOT NULL) AS BIGINT) AS holder_count, count(*) AS n FROM holders GROUP BY 1, 2")
def _(t):
    return t.holders.groupBy("chain", "address").agg(M.latest("holder_count", "observed_at", "seq").cast("long").alias("holder_count"), F.count("*").alias("n"))


@query("any_dex", "SELECT pair_address, min(dex) AS dex FROM trades GROUP BY 1")
def _(t):
    return t.trades.groupBy("pair_address").agg(F.min("dex").alias("dex"))


def _bars_sql(seconds):
    k = "sec * 1000000000 + block_number * 100000000 + log_index"
    return f"SELECT chain, pair_address, sec - sec % {seconds} AS bucket, round(arg_min(price_usd, {k}), 6) AS open, round(max(price_usd), 6) AS high, round(min(price_usd), 6) AS low, round(arg_max(price_usd, {k}), 6) AS close, round(sum(coalesce(amount_usd, 0)), 6) AS volume, count(*) AS n_trades FROM trades WHERE price_usd IS NOT NULL GROUP BY 1, 2, 3"


for _name, _seconds in (("ohlcv_1h", 3600), ("ohlcv_4h", 14400), ("ohlcv_1d", 86400)):
    query(_name, _bars_sql(_seconds))(lambda t, s=_seconds: rounded(M.ohlcv(t.trades, s)))


@query("ohlcv_earliest", f"WITH b AS ({_bars_sql(3600)}) SELECT * FROM (SELECT * FROM b WHERE pair_address = 'pool7' ORDER BY bucket LIMIT 20)")
def _(t):
    return rounded(M.ohlcv(t.trades.where("pair_address = 'pool7'"), 3600)).orderBy("bucket").limit(20)


@query("flow_bars", "SELECT pair_address, sec // 3600 AS hour, round(arg_max(price_usd, block_number * 100000000 + log_index), 6) AS price, (max_by(struct_pack(r := reserve_usd), block_number * 100000000 + log_index)).r AS reserve, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'buy'), 0), 6) AS buy_usd, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'sell'), 0), 6) AS sell_usd FROM trades WHERE price_usd > 0 GROUP BY 1, 2")
def _(t):
    return rounded(M.flow_bars(t.trades))


@query("sync_swap_bars", "WITH s AS (SELECT pair_address, sec // 3600 AS hour, round(arg_max(price_usd, sec * 1000000000 + log_index), 6) AS close FROM trades WHERE side IS NULL AND price_usd IS NOT NULL GROUP BY 1, 2), v AS (SELECT pair_address, sec // 3600 AS hour, sum(amount_usd) AS volume, count(*) AS n FROM trades WHERE side IS NOT NULL GROUP BY 1, 2) SELECT s.pair_address, s.hour, s.close, round(nullif(v.volume, 0), 6) AS volume, v.n AS n_trades FROM s LEFT JOIN v USING (pair_address, hour)")
def _(t):
    x = t.trades.withColumn("hour", F.floor(F.col("sec") / 3600))
    state = x.where("side is null and price_usd is not null").groupBy("pair_address", "hour").agg(F.max_by("price_usd", F.struct("sec", "log_index")).alias("close"))
    flow = x.where("side is not null").groupBy("pair_address", "hour").agg(F.sum("amount_usd").alias("v"), F.count("*").alias("n_trades"))
    return rounded(state.join(flow, ["pair_address", "hour"], "left").select("pair_address", "hour", "close", F.nullif("v", F.lit(0.0)).alias("volume"), "n_trades"))


@query("bars_last_known_reserve", "WITH x AS (SELECT pair_address, sec // 14400 AS b, coalesce(price_usd, amount_usd) AS p, reserve_usd, sec * 1000000000 + log_index AS k FROM trades) SELECT pair_address, b, round(arg_max(p, k), 6) AS close, coalesce(arg_max(reserve_usd, k) FILTER (WHERE reserve_usd IS NOT NULL), NULL) AS reserve, count(*) AS n FROM x GROUP BY 1, 2")
def _(t):
    x = t.trades.select("pair_address", F.floor(F.col("sec") / 14400).alias("b"), F.coalesce("price_usd", "amount_usd").alias("p"), "reserve_usd", "sec", "log_index")
    return rounded(x.groupBy("pair_address", "b").agg(M.latest("p", "sec", "log_index").alias("close"), M.latest("reserve_usd", "sec", "log_index").alias("reserve"), F.count("*").alias("n")))


@query("order_flow", """WITH w AS (SELECT pair_address, quantile_cont(amount_usd, 0.95) AS whale FROM trades GROUP BY 1),
x AS (SELECT t.*, sec // 3600 AS hour, w.whale, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS g FROM trades t JOIN w USING (pair_address))
SELECT pair_address, hour, count(*) AS n_trades, count(*) FILTER (WHERE side = 'buy') AS n_buy, count(*) FILTER (WHERE side = 'sell') AS n_sell, round(sum(g * amount_usd), 6) AS net_usd,
 round(coalesce(sum(g * amount_usd) / nullif(sum(amount_usd) FILTER (WHERE side IS NOT NULL), 0), 0), 6) AS ofi_usd,
 round(coalesce(CAST(sum(g) AS DOUBLE) / nullif(count(side), 0), 0), 6) AS ofi_cnt, round(coalesce(sum(CASE WHEN amount_usd >= whale THEN g * amount_usd ELSE 0 END), 0), 6) AS whale_net_usd,
 count(DISTINCT maker) AS n_makers, round(median(reserve_usd), 6) AS reserve_usd FROM x GROUP BY 1, 2""")
def _(t):
    return rounded(M.order_flow(t.trades))


@query("whale_threshold", "SELECT pair_address, round(quantile_cont(amount_usd, 0.95), 6) AS whale FROM trades GROUP BY 1")
def _(t):
    return rounded(quantiles(t.trades, ["pair_address"], "amount_usd", {"whale": 0.95}))


@query("daily_flow", "SELECT pair_address, sec // 86400 AS day, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'buy'), 0), 6) AS buy_usd, round(coalesce(sum(amount_usd) FILTER (WHERE side = 'sell'), 0), 6) AS sell_usd, count(DISTINCT maker) FILTER (WHERE side = 'buy') AS buyers, count(*) AS n FROM trades GROUP BY 1, 2")
def _(t):
    x = t.trades.withColumn("day", F.floor(F.col("sec") / 86400))
    return rounded(x.groupBy("pair_address", "day").agg(M.side_sum("buy").alias("buy_usd"), M.side_sum("sell").alias("sell_usd"), F.count_distinct(F.when(F.col("side") == "buy", F.col("maker"))).alias("buyers"), F.count("*").alias("n")))


@query("distinct_pairs", "SELECT DISTINCT pair_address, dex FROM trades")
def _(t):
    return t.trades.select("pair_address", "dex").distinct()


@query("newest_coins", "SELECT token0 AS coin, max(coalesce(created_block, 0)) AS created_block FROM pool_universe GROUP BY 1 ORDER BY created_block DESC, coin LIMIT 5")
def _(t):
    return M.newest_first(t.pool_universe.withColumnRenamed("token0", "coin"), "coin", "created_block", 5)


@query("token_aggregate", "SELECT token, arg_max(pool, reserve_usd * 1000000 + id) AS deepest, round(max(reserve_usd), 6) AS top_usd, round(sum(reserve_usd), 6) AS liquidity_usd, count(*) AS n FROM pools GROUP BY 1")
def _(t):
    return rounded(t.pools.groupBy("token").agg(F.max_by("pool", F.struct("reserve_usd", "id")).alias("deepest"), F.max("reserve_usd").alias("top_usd"), F.sum("reserve_usd").alias("liquidity_usd"), F.count("*").alias("n")))


@query("liquidity_graph", """WITH x AS (SELECT * FROM pools WHERE reserve_usd > 0), d AS (SELECT token, dex, sum(reserve_usd) AS r FROM x GROUP BY 1, 2), f AS (SELECT token, concat(fee_bps, 'bps') AS tier, sum(reserve_usd) AS r FROM x GROUP BY 1, 2)
SELECT token, count(*) AS n_pools, round(sum(reserve_usd), 4) AS total_usd, round(max(reserve_usd) / sum(reserve_usd), 6) AS dominant_share,
 (SELECT string_agg(concat(dex, ':', CAST(CAST(round(r) AS BIGINT) AS STRING)), ',' ORDER BY r DESC, dex) FROM d WHERE d.token = x.token) AS by_dex,
 (SELECT string_agg(concat(tier, ':', CAST(CAST(round(r) AS BIGINT) AS STRING)), ',' ORDER BY r DESC, tier) FROM f WHERE f.token = x.token) AS by_tier FROM x GROUP BY token""")
def _(t):
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"]).cast("long").cast("string"))), ",")
    g = M.liquidity_graph(t.pools)
    return g.select("token", "n_pools", F.round("total_usd", 4).alias("total_usd"), F.round("dominant_share", 6).alias("dominant_share"), text("by_dex").alias("by_dex"), text("by_tier").alias("by_tier"))


@query("universe_stats", "SELECT dex, count(*) AS n, count(created_sec) AS with_created_at FROM pool_universe GROUP BY 1")
def _(t):
    return t.pool_universe.groupBy("dex").agg(F.count("*").alias("n"), F.count("created_sec").alias("with_created_at"))


_BAL = "SELECT token, holder, sum(v) AS balance FROM (SELECT token, src AS holder, -value AS v FROM transfers WHERE value <> 0 {0} UNION ALL SELECT token, dst, value FROM transfers WHERE value <> 0 {0}) WHERE holder <> '0x0' GROUP BY 1, 2 HAVING sum(v) > 0"


@query("holder_balances", f"SELECT token, holder, CAST(balance AS BIGINT) AS balance FROM ({_BAL.format('')})")
def _(t):
    return M.balances(t.transfers, ["token"], ["0x0"])


@query("holders_at_block", f"SELECT token, holder, CAST(balance AS BIGINT) AS balance FROM ({_BAL.format('AND block <= 5000')})")
def _(t):
    return M.balances(t.transfers, ["token"], ["0x0"], 5000)


@query("holder_concentration", f"""WITH b AS ({_BAL.format('')}), x AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance DESC, holder) AS r, row_number() OVER (PARTITION BY token ORDER BY balance, holder) AS a, sum(balance) OVER (PARTITION BY token) AS s FROM b)
SELECT token, count(*) AS n_holders, CAST(sum(balance) AS BIGINT) AS total, round(sum(balance) FILTER (WHERE r <= 10) / CAST(max(s) AS DOUBLE), 6) AS top10, round(sum(balance) FILTER (WHERE r <= 50) / CAST(max(s) AS DOUBLE), 6) AS top50, round(sum((balance / CAST(s AS DOUBLE)) ** 2), 6) AS hhi,
 round(2.0 * CAST(sum(a * balance) AS DOUBLE) / (count(*) * CAST(max(s) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE), 6) AS gini FROM x GROUP BY token""")
def _(t):
    return rounded(M.concentration(M.balances(t.transfers, ["token"], ["0x0"]), ["token"]))


@query("token_supply", "SELECT token, CAST(sum(CASE WHEN src = '0x0' THEN value ELSE 0 END) AS BIGINT) AS minted, CAST(sum(CASE WHEN dst = '0x0' THEN value ELSE 0 END) AS BIGINT) AS burned FROM transfers GROUP BY 1")
def _(t):
    return M.supply(t.transfers, ["token"], ["0x0"])


@query("wallet_position", "SELECT token, wallet, CAST(sum(i) AS BIGINT) AS received, CAST(sum(o) AS BIGINT) AS sent, CAST(sum(i) - sum(o) AS BIGINT) AS position, round(CAST(sum(i) - sum(o) AS DOUBLE) * 1.25, 6) AS unrealised_usd, CAST(0 AS DOUBLE) AS realised_usd FROM (SELECT token, src AS wallet, 0 AS i, value AS o FROM transfers UNION ALL SELECT token, dst, value, 0 FROM transfers) GROUP BY 1, 2")
def _(t):
    return rounded(M.wallet_position(t.transfers, ["token"], 1.25))


@query("holder_series", "SELECT address, observed_at, CAST(holder_count AS BIGINT) AS holder_count FROM holders WHERE holder_count IS NOT NULL AND address = 'pool7'")
def _(t):
    return t.holders.where("holder_count is not null and address = 'pool7'").select("address", "observed_at", F.col("holder_count").cast("long").alias("holder_count"))


@query("new_launches", "SELECT chain, pair_address, created_sec FROM pool_universe ORDER BY created_sec DESC NULLS LAST, pair_address LIMIT 30")
def _(t):
    return t.pool_universe.select("chain", "pair_address", "created_sec").orderBy(F.col("created_sec").desc_nulls_last(), "pair_address").limit(30)


@query("pools_of_token", "SELECT pair_address, token0, token1 FROM pool_universe WHERE lower(token0) = 't3' OR lower(token1) = 't3'")
def _(t):
    return t.pool_universe.where((F.lower("token0") == "t3") | (F.lower("token1") == "t3")).select("pair_address", "token0", "token1")


@query("reverts", "SELECT user_id % 3 AS g, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS reverted, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS rate, round(avg(value) FILTER (WHERE event_type = 'error') * count(*) FILTER (WHERE event_type = 'error') / 1e9, 12) AS gas_lost FROM events GROUP BY 1")
def _(t):
    bad = F.col("event_type") == "error"
    n = F.count_if(bad)
    return t.events.groupBy((F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("n"), n.alias("reverted"), F.round(n / F.count("*"), 6).alias("rate"), F.round(F.avg(F.when(bad, F.col("value"))) * n / 1e9, 12).alias("gas_lost"))


@query("block_density", "SELECT n, count(*) AS blocks FROM (SELECT pair_address, block_number, count(*) AS n FROM trades GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.trades.groupBy("pair_address", "block_number").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("blocks"))


@query("field_merge", """WITH r AS (SELECT user_id, event_type AS source, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS p, max(CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS STRING) END) AS name, max(CASE WHEN event_id % 2 = 0 THEN value END) AS price FROM events GROUP BY 1, 2, 3)
SELECT user_id, arg_min(name, p) FILTER (WHERE name <> '') AS name, round(arg_min(price, p) FILTER (WHERE price IS NOT NULL), 6) AS price, string_agg(source, '+' ORDER BY p) AS source FROM r GROUP BY 1""")
def _(t):
    p = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 4).otherwise(5)
    r = t.events.groupBy("user_id", F.col("event_type").alias("src"), p.alias("p")).agg(F.max(F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_id").cast("string"))).alias("name"), F.max(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("price"))
    return rounded(M.best_by_priority(r, ["user_id"], "p", ["name", "price"], "src"))


@query("risk_merge", "SELECT user_id, round(max(value), 6) AS score, bool_or(CASE event_type WHEN 'error' THEN true WHEN 'view' THEN false END) AS honeypot, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS flags FROM events GROUP BY 1")
def _(t):
    flag = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "view", False)
    x = t.events.select("user_id", F.col("value").alias("score"), flag.alias("honeypot"), F.array("event_type").alias("flags"))
    return rounded(M.worst_case(x, ["user_id"], ["score"], ["honeypot"], ["flags"]).withColumn("flags", F.array_join("flags", ",")))


@query("provider_fallback", "WITH r AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS p, sum(value) AS v FROM events WHERE value > 5 GROUP BY 1, 2) SELECT user_id, min(p) AS provider, round(arg_min(v, p), 6) AS v FROM r GROUP BY 1")
def _(t):
    p = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    r = t.events.where("value > 5").groupBy("user_id", p.alias("p")).agg(F.sum("value").alias("v"))
    return rounded(M.first_of_key(r, ["user_id"], F.col("p")).select("user_id", F.col("p").alias("provider"), "v"))


@query("two_sided_flow_join", "WITH f AS (SELECT pair_address, sec // 86400 AS day, sum(amount_usd) AS usd FROM trades GROUP BY 1, 2), p AS (SELECT pair_address, sec // 86400 AS day, avg(price_usd) AS price FROM trades GROUP BY 1, 2) SELECT pair_address, day, round(usd, 6) AS usd, round(price, 6) AS price FROM f JOIN p USING (pair_address, day)")
def _(t):
    x = t.trades.withColumn("day", F.floor(F.col("sec") / 86400))
    f, p = x.groupBy("pair_address", "day").agg(F.sum("amount_usd").alias("usd")), x.groupBy("pair_address", "day").agg(F.avg("price_usd").alias("price"))
    return rounded(f.join(p, ["pair_address", "day"]))


@query("dictionary_lookup", "WITH d AS (SELECT dex, max(pair_address) AS pair FROM pool_universe GROUP BY 1) SELECT t.dex, d.pair, count(*) AS n FROM trades t JOIN d USING (dex) GROUP BY 1, 2")
def _(t):
    d = t.pool_universe.groupBy("dex").agg(F.max("pair_address").alias("pair"))
    return t.trades.join(d, "dex").groupBy("dex", "pair").agg(F.count("*").alias("n"))


@query("covered_window", "WITH w AS (SELECT pair_address, min(sec) AS lo, max(sec) AS hi FROM trades WHERE side IS NULL GROUP BY 1) SELECT t.pair_address, count(*) AS n FROM trades t JOIN w ON w.pair_address = t.pair_address AND t.sec BETWEEN w.lo AND w.hi GROUP BY 1")
def _(t):
    w = t.trades.where("side is null").groupBy("pair_address").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    return t.trades.join(w, "pair_address").where("sec between lo and hi").groupBy("pair_address").agg(F.count("*").alias("n"))


@query("meta_left_join", "SELECT b.pair_address, m.chain, round(m.reserve_usd, 4) AS reserve_usd, count(*) AS n FROM bars b LEFT JOIN meta m ON m.pair_address = b.pair_address AND m.parts % 2 = 0 GROUP BY 1, 2, 3")
def _(t):
    m = t.meta.where("parts % 2 = 0").select("pair_address", "chain", "reserve_usd")
    return rounded(t.bars.groupBy("pair_address").agg(F.count("*").alias("n")).join(m, "pair_address", "left").select("pair_address", "chain", "reserve_usd", "n"), 4)


@query("semi_dex_only", "SELECT pair_address, count(*) AS n FROM trades WHERE pair_address IN (SELECT pair_address FROM pool_universe WHERE dex = 'dex2') GROUP BY 1")
def _(t):
    return t.trades.join(t.pool_universe.where("dex = 'dex2'"), "pair_address", "left_semi").groupBy("pair_address").agg(F.count("*").alias("n"))


@query("anti_done_set", "SELECT DISTINCT pair_address FROM trades t WHERE NOT EXISTS (SELECT 1 FROM pool_universe p WHERE p.pair_address = t.pair_address)")
def _(t):
    return t.trades.select("pair_address").distinct().join(t.pool_universe, "pair_address", "left_anti")


@query("liveness", "WITH l AS (SELECT pair_address, count(*) AS recent FROM trades WHERE sec >= (SELECT max(sec) FROM trades) - 86400 GROUP BY 1) SELECT p.pair_address, coalesce(l.recent, 0) AS recent, CASE WHEN l.recent IS NULL THEN 'dead' ELSE 'live' END AS status FROM pool_universe p LEFT JOIN l USING (pair_address)")
def _(t):
    edge = t.trades.agg(F.max("sec").alias("edge"))
    live = t.trades.join(F.broadcast(edge)).where("sec >= edge - 86400").groupBy("pair_address").agg(F.count("*").alias("recent"))  # edge: one row
    out = t.pool_universe.select("pair_address").join(live, "pair_address", "left")
    return out.select("pair_address", F.coalesce("recent", F.lit(0)).alias("recent"), F.when(F.col("recent").isNull(), "dead").otherwise("live").alias("status"))


@query("as_of_reserve", """WITH s AS (SELECT pair_address, sec, log_index, reserve_usd FROM trades WHERE side IS NULL AND reserve_usd IS NOT NULL)
SELECT t.log_index, (SELECT s.reserve_usd FROM s WHERE s.pair_address = t.pair_address AND s.sec <= t.sec ORDER BY s.sec DESC, s.log_index DESC LIMIT 1) AS reserve_usd_as_of FROM trades t WHERE t.side = 'buy'""")
def _(t):
    from ammlytics.functions.rolling import as_of

    state = t.trades.where("side is null and reserve_usd is not null").select("pair_address", "sec", "log_index", "reserve_usd")
    buys = t.trades.where("side = 'buy'").select("pair_address", "sec", "log_index")
    return as_of(buys, state.withColumnRenamed("log_index", "tie"), ["pair_address"], "sec", "sec", "reserve_usd", "tie").select("log_index", "reserve_usd_as_of")


@query("jsonl_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("upsert_by_pair", "SELECT pair_address, sec, log_index FROM trades WHERE block_number < 3 AND pair_address NOT IN (SELECT pair_address FROM trades WHERE block_number >= 3 AND dex = 'dex1') UNION ALL SELECT pair_address, sec, log_index FROM trades WHERE block_number >= 3 AND dex = 'dex1'")
def _(t):
    from ammlytics.sources.lake import upserted

    cols = ("pair_address", "sec", "log_index")
    return upserted(t.trades.where("block_number < 3").select(*cols), t.trades.where("block_number >= 3 and dex = 'dex1'").select(*cols), ["pair_address"])


@query("tape_scan", "SELECT pair_address, sec, amount_usd, side FROM trades WHERE pair_address IN ('pool1', 'pool2', 'pool3', 'pool4', 'pool5') AND amount_usd > 0")
def _(t):
    return t.trades.where(F.col("pair_address").isin("pool1", "pool2", "pool3", "pool4", "pool5") & (F.col("amount_usd") > 0)).select("pair_address", "sec", "amount_usd", "side")


@query("dedup_last", "SELECT pair_address, sec // 60 AS minute, arg_max(log_index, sec * 1000000000 + log_index) AS log_index FROM trades GROUP BY 1, 2")
def _(t):
    x = t.trades.withColumn("minute", F.floor(F.col("sec") / 60))
    return M.first_of_key(x, ["pair_address", "minute"], F.desc("sec"), F.desc("log_index")).select("pair_address", "minute", "log_index")


@query("forward_fill", "SELECT log_index, last_value(reserve_usd IGNORE NULLS) OVER (PARTITION BY pair_address ORDER BY sec, log_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, coalesce(last_value(reserve_usd IGNORE NULLS) OVER (PARTITION BY pair_address ORDER BY sec, log_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(reserve_usd IGNORE NULLS) OVER (PARTITION BY pair_address ORDER BY sec, log_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS both_ways FROM trades")
def _(t):
    w = Window.partitionBy("pair_address").orderBy("sec", "log_index")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = F.last("reserve_usd", ignorenulls=True).over(back)
    return t.trades.select("log_index", filled.alias("filled"), F.coalesce(filled, F.first("reserve_usd", ignorenulls=True).over(ahead)).alias("both_ways"))


@query("union_by_name", "SELECT pair_address, side, CAST(NULL AS STRING) AS maker FROM trades WHERE side = 'buy' UNION ALL SELECT pair_address, NULL, maker FROM trades WHERE side = 'sell'")
def _(t):
    return t.trades.where("side = 'buy'").select("pair_address", "side").unionByName(t.trades.where("side = 'sell'").select("pair_address", "maker"), allowMissingColumns=True)


@query("composite_dedup", "SELECT DISTINCT pair_address, maker, side FROM trades")
def _(t):
    return t.trades.dropDuplicates(["pair_address", "maker", "side"]).select("pair_address", "maker", "side")


@query("distribution", "SELECT dex, count(amount_usd) AS n, round(quantile_cont(amount_usd, 0.10), 6) AS p10, round(quantile_cont(amount_usd, 0.25), 6) AS p25, round(quantile_cont(amount_usd, 0.5), 6) AS p50, round(quantile_cont(amount_usd, 0.75), 6) AS p75, round(quantile_cont(amount_usd, 0.9), 6) AS p90, round(avg(least(amount_usd, 10)), 6) AS mean, round(avg(CASE WHEN amount_usd > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM trades GROUP BY 1")
def _(t):
    return rounded(M.distribution(t.trades, "amount_usd", ["dex"]))


@query("props_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
