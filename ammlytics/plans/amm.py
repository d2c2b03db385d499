"""Queries over pools, costs, routes, ticks, sandwiches, dispersion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.operators import amm as A
from ammlytics.operators import market as M
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query

_FEE = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{k}') THEN {v}" for k, v in C.FEE_BPS) + f" ELSE {C.DEFAULT_FEE_BPS} END"
_GAS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.GAS_USD.items()) + " ELSE 0.05 END"


def _impact(side, size, reserve):
    x = f"({size}) / (({reserve}) / 2)"
    return f"(CASE WHEN ({reserve}) IS NULL OR ({reserve}) <= 0 THEN 1.0 ELSE {x if side == 'buy' else f'{x} / (1 + {x})'} END)"


def _round_trip(size, reserve, fee, gas):
    return f"(greatest({_impact('buy', size, reserve)}, 0.0002) + greatest({_impact('sell', size, reserve)}, 0.0002) + 2 * ({fee}) / 10000 + 2 * ({gas}) / ({size}))"


_VENUE = "CASE l_suppkey % 6 WHEN 0 THEN 'PancakeSwap-v3' WHEN 1 THEN 'uniswap_v2' WHEN 2 THEN 'Raydium' WHEN 3 THEN 'pumpswap' WHEN 4 THEN 'biswap' ELSE 'other' END"


@query("swap_fees", f"SELECT v, {_FEE.format('v')} AS fee_bps, count(*) AS n FROM (SELECT {_VENUE} AS v FROM lineitem) GROUP BY 1, 2")
def _(t):
    v = t.lineitem.select(F.expr(_VENUE).alias("v"))
    return v.groupBy("v", C.swap_fee_bps(F.col("v")).alias("fee_bps")).agg(F.count("*").alias("n"))


@query("gas_cost", "SELECT chain, round(avg(CASE WHEN log_index % 2 = 0 THEN 0.00005 * 600 WHEN chain = 'bsc' THEN 120000 * 1e-9 * 600 ELSE 0.02 END), 6) AS gas FROM trades GROUP BY 1")
def _(t):
    native = F.when(F.col("log_index") % 2 == 0, F.lit(0.00005))
    return rounded(t.trades.groupBy("chain").agg(F.avg(C.gas_cost_usd(F.col("chain"), F.lit(600.0), native=native)).alias("gas")))


@query("leg_costs", f"SELECT log_index, round({_impact('buy', 'amount_usd', 'reserve_usd')}, 9) AS buy_impact, round({_impact('sell', 'amount_usd', 'reserve_usd')}, 9) AS sell_impact, round(price_usd * (1 + greatest({_impact('buy', 'amount_usd', 'reserve_usd')}, 0.0002) + 0.003 + 0.2 / amount_usd), 9) AS exec_price FROM trades WHERE amount_usd > 1")
def _(t):
    x = t.trades.where("amount_usd > 1")
    leg = C.leg_cost(F.lit("buy"), F.col("price_usd"), F.col("amount_usd"), F.col("reserve_usd"), F.lit(30.0), F.lit(0.2))
    return rounded(x.select("log_index", C.price_impact(F.lit("buy"), F.col("amount_usd"), F.col("reserve_usd")).alias("buy_impact"), C.price_impact(F.lit("sell"), F.col("amount_usd"), F.col("reserve_usd")).alias("sell_impact"), leg["exec_price"].alias("exec_price")), 9)


@query("round_trip_cost", f"SELECT id, round({_round_trip('1000', 'reserve_usd', 'fee_bps', '0.2')}, 8) AS cost, round(CASE WHEN id % 5 = 0 THEN 0.05 ELSE {_round_trip('greatest(50, 0.0025 * reserve_usd)', 'reserve_usd', '30', _GAS.format('chain'))} END, 8) AS study FROM pools")
def _(t):
    r = F.when(F.col("id") % 5 != 0, F.col("reserve_usd"))
    return rounded(t.pools.select("id", C.round_trip_cost(F.lit(1000.0), F.col("reserve_usd"), F.col("fee_bps"), F.lit(0.2)).alias("cost"), C.study_cost(F.col("chain"), r).alias("study")), 8)


@query("depth_cost", "SELECT id, round(greatest(500 / (0.3 * reserve_usd), 0.0002) + greatest(500 / (0.3 * reserve_usd) / (1 + 500 / (0.3 * reserve_usd)), 0.0002) + 2 * fee_bps / 10000 + 2 * 0.2 / 500 + 2 * 5 / 10000.0, 8) AS cost FROM pools")
def _(t):
    return rounded(t.pools.select("id", C.depth_cost(F.lit(500.0), F.col("reserve_usd"), F.col("fee_bps"), F.lit(0.2), 0.3, 5.0).alias("cost")), 8)


@query("cost_curve", f"SELECT pool, size, round({_round_trip('size', 'r', '30', '0.2')}, 8) AS cost FROM (SELECT pool, max(reserve_usd) AS r FROM pools GROUP BY 1), (VALUES (1000), (50000), (250000)) v(size)")
def _(t):
    x = t.pools.groupBy("pool").agg(F.max("reserve_usd").alias("r")).withColumn("size", F.explode(F.array(F.lit(1000), F.lit(50000), F.lit(250000))))
    return rounded(x.select("pool", "size", C.round_trip_cost(F.col("size").cast("double"), F.col("r"), F.lit(30.0), F.lit(0.2)).alias("cost")), 8)


_POOLS = "SELECT token, pool || '-' || id AS pool, 1 + (id % 50) / 1000.0 AS mid, reserve_usd / 2 AS depth, fee_bps FROM pools"
_ROUTE = """WITH p AS ({pools}), x AS (SELECT *, {b} AS b FROM p), y AS (SELECT *, sum(depth) OVER o AS r, sum(depth / b) OVER o AS q FROM x WINDOW o AS (PARTITION BY token ORDER BY b {dir}, pool)),
z AS (SELECT *, {level} AS lv FROM y), f AS (SELECT token, arg_max(lv, r) AS level FROM z WHERE lv {cmp} b GROUP BY 1)
SELECT token, pool, round(greatest({part}, 0), 4) AS part, round(f.level, 8) AS level FROM z JOIN f USING (token)"""


def _route(side):
    return lambda t: A.split_route(t.sql(_POOLS), 20000.0, side).select("token", "pool", F.round("part", 4).alias("part"), F.round("level", 8).alias("level"))


_BUY = _ROUTE.format(pools=_POOLS, b="mid / (1 - fee_bps / 10000.0)", dir="ASC", level="(20000 + r) / q", cmp=">", part="depth * (f.level / b - 1)")
_SELL = _ROUTE.format(pools=_POOLS, b="mid * (1 - fee_bps / 10000.0)", dir="DESC", level="(r - 20000) / q", cmp="<", part="depth * (1 - f.level / b)")
for _side, _sql in (("buy", _BUY), ("sell", _SELL)):
    for _name in (f"split_route_{_side}", f"split_route_{_side}_all"):  # two names of one query
        query(_name, _sql)(_route(_side))


_TICKS = "SELECT pool, tick, CAST(sum(d) AS BIGINT) AS net FROM (SELECT pool, tick_lower AS tick, dl AS d FROM liquidity UNION ALL SELECT pool, tick_upper, -dl FROM liquidity) GROUP BY 1, 2 HAVING sum(d) <> 0"


@query("tick_map", _TICKS)
def _(t):
    return A.tick_map(t.liquidity)


@query("liquidity_profile", f"SELECT pool, tick, net, CAST(sum(net) OVER (PARTITION BY pool ORDER BY tick) AS BIGINT) AS liquidity FROM ({_TICKS})")
def _(t):
    return A.liquidity_profile(A.tick_map(t.liquidity))


@query("tick_prices", "SELECT tick, round(1.0001 ** (tick / 2.0), 8) AS root, CAST(floor(2 * ln(1.0001 ** (tick / 2.0)) / ln(1.0001) + 1e-9) AS BIGINT) AS back FROM (SELECT DISTINCT tick_upper AS tick FROM liquidity)")
def _(t):
    root = C.sqrt_price_of_tick(F.col("tick"))
    return t.liquidity.select(F.col("tick_upper").alias("tick")).distinct().select("tick", F.round(root, 8).alias("root"), C.tick_of_sqrt_price(root).alias("back"))


@query("tick_slippage", f"""WITH m AS ({_TICKS}), p AS (SELECT pool, tick, sum(net) OVER (PARTITION BY pool ORDER BY tick) AS l, lead(tick) OVER (PARTITION BY pool ORDER BY tick) AS nx FROM m),
b AS (SELECT pool, tick, l, 1.0001 ** (greatest(tick, 0) / 2.0) AS a, 1.0001 ** (nx / 2.0) AS b FROM p WHERE nx > 0 AND l > 0), w AS (SELECT *, l * (b - a) AS take, sum(l * (b - a)) OVER (PARTITION BY pool ORDER BY tick) - l * (b - a) AS before FROM b),
u AS (SELECT *, least(greatest(20 - before, 0), take) AS used FROM w), o AS (SELECT *, CASE WHEN used <= 0 THEN 0 WHEN used >= take THEN l * (1 / a - 1 / b) ELSE l * (1 / a - 1 / (a + used / l)) END AS out FROM u)
SELECT pool, round(sum(used), 6) AS filled, round(sum(out), 6) AS received, count(*) FILTER (WHERE used > 0) AS bands, round(sum(used) / sum(out) - 1, 6) AS impact, sum(used) >= 19.98 AS fully_filled FROM o GROUP BY 1""")
def _(t):
    state = t.liquidity.select("pool").distinct().withColumn("tick", F.lit(0))
    return rounded(A.tick_slippage(A.tick_map(t.liquidity), state, 20.0, "buy"))


_CAND = """WITH x AS (SELECT *, min(CASE WHEN side = 'sell' THEN log_index END) OVER (PARTITION BY pair_address, block_number, maker ORDER BY log_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sell FROM trades)
SELECT a.pair_address, a.block_number, a.maker AS attacker, a.log_index AS front, a.sell AS back, count(*) AS victims FROM x a JOIN trades v ON v.pair_address = a.pair_address AND v.block_number = a.block_number AND v.side = 'buy' AND v.maker <> a.maker AND v.log_index > a.log_index AND v.log_index < a.sell
WHERE a.side = 'buy' AND a.sell IS NOT NULL GROUP BY ALL"""


@query("sandwich_candidates", _CAND)
def _(t):
    return A.sandwich_candidates(t.trades)


# The rule in SQL: a walk over each maker's buys in a block, then the victims of all attacks
_ATTACKS = """x AS (SELECT *, row_number() OVER (PARTITION BY pair_address, block_number ORDER BY log_index, maker) AS pos FROM trades), b AS (SELECT pair_address, block_number, maker, pos, row_number() OVER (PARTITION BY pair_address, block_number, maker ORDER BY pos) AS k FROM x WHERE side = 'buy' AND maker IS NOT NULL),
z AS (SELECT pair_address, block_number, maker, pos AS s FROM x WHERE side = 'sell' AND maker IS NOT NULL), pb AS (SELECT pair_address, block_number, pos, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_address, block_number ORDER BY pos) AS nb, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_address, block_number, maker ORDER BY pos) AS ob FROM x),
w AS (SELECT pair_address, block_number, maker, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS front, CAST(0 AS BIGINT) AS back, CAST(0 AS BIGINT) AS last FROM b WHERE k = 1 UNION ALL
 SELECT pair_address, block_number, maker, k, pos, j, CASE WHEN hit THEN j ELSE last END FROM (SELECT n.*, coalesce(q.nb - p.nb > q.ob - p.ob, false) AS hit FROM (SELECT w.pair_address, w.block_number, w.maker, b.k, b.pos, w.last, min(z.s) AS j FROM w JOIN b ON b.pair_address = w.pair_address AND b.block_number = w.block_number AND b.maker = w.maker AND b.k = w.k + 1 LEFT JOIN z ON z.pair_address = w.pair_address AND z.block_number = w.block_number AND z.maker = w.maker AND z.s > greatest(b.pos, w.last) GROUP BY ALL) n
  LEFT JOIN pb p ON p.pair_address = n.pair_address AND p.block_number = n.block_number AND p.pos = n.pos LEFT JOIN pb q ON q.pair_address = n.pair_address AND q.block_number = n.block_number AND q.pos = n.j)),
att AS (SELECT pair_address, block_number, maker, front, back FROM w WHERE k > 0 AND back IS NOT NULL AND last = back AND back > front), first AS (SELECT pair_address, block_number, arg_min(price_usd, pos) FILTER (WHERE price_usd > 0) AS pre, count(*) AS trades FROM x GROUP BY 1, 2 HAVING count(*) >= 3),
v AS (SELECT v.pair_address, v.block_number, v.pos, v.price_usd, count(*) AS around FROM att JOIN x v ON v.pair_address = att.pair_address AND v.block_number = att.block_number AND v.side = 'buy' AND v.maker IS DISTINCT FROM att.maker AND v.pos > att.front AND v.pos < att.back GROUP BY ALL)"""
_BY_BLOCK = f"WITH RECURSIVE {_ATTACKS}, n AS (SELECT pair_address, block_number, count(*) AS attacks FROM att GROUP BY 1, 2), c AS (SELECT pair_address, block_number, CAST(sum({{0}}) AS BIGINT) AS victims, sum({{0}} * greatest(0, price_usd / pre - 1)) FILTER (WHERE price_usd > 0) AS e, CAST(sum({{0}}) FILTER (WHERE price_usd > 0) AS BIGINT) AS priced FROM v JOIN first USING (pair_address, block_number) GROUP BY 1, 2)"
_SANDWICHES = _BY_BLOCK + " SELECT pair_address, block_number, coalesce(attacks, 0) AS attacks, coalesce(victims, 0) AS victims, round(coalesce(e / priced, 0), 6) AS extra, coalesce(priced, 0) AS priced, trades FROM first LEFT JOIN n USING (pair_address, block_number) LEFT JOIN c USING (pair_address, block_number)"


@query("sandwiches", _SANDWICHES.format("1"))
def _(t):
    """Attacks and victims in each block."""
    return rounded(A.detect_sandwiches(t.trades))


@query("sandwiches_recounted", _SANDWICHES.format("around"))
def _(t):
    """The same, a victim counting for every attack around it."""
    return rounded(A.detect_sandwiches(t.trades, once=False))


@query("sandwich_table", _BY_BLOCK.format("around") + ", p AS (SELECT pair_address, count(*) AS n_trades, count(DISTINCT block_number) AS n_blocks FROM x GROUP BY 1 HAVING count(*) >= 10), a AS (SELECT pair_address, sum(attacks) AS attacks FROM n JOIN first USING (pair_address, block_number) GROUP BY 1), s AS (SELECT pair_address, sum(victims) AS victims, sum(e) AS e, sum(priced) AS priced FROM c GROUP BY 1) SELECT pair_address, n_trades, n_blocks, CAST(coalesce(attacks, 0) AS BIGINT) AS attacks, CAST(coalesce(victims, 0) AS BIGINT) AS victims, round(coalesce(victims, 0) / CAST(n_trades AS DOUBLE), 6) AS victim_rate, round(coalesce(e / nullif(priced, 0) * 10000, 0), 4) AS mean_extra_bp FROM p LEFT JOIN a USING (pair_address) LEFT JOIN s USING (pair_address)")
def _(t):
    x = A.sandwich_table(t.trades)
    return x.select("pair_address", "n_trades", "n_blocks", "attacks", "victims", F.round("victim_rate", 6).alias("victim_rate"), F.round("mean_extra_bp", 4).alias("mean_extra_bp"))


@query("mev_pad", "SELECT dex, round(greatest(0.001, coalesce(0.02 * count(*) FILTER (WHERE side = 'buy') / CAST(count(*) AS DOUBLE), 0)), 8) AS pad FROM trades GROUP BY 1")
def _(t):
    share = F.count_if(F.col("side") == "buy") / F.count("*")
    return rounded(t.trades.groupBy("dex").agg(C.mev_pad(F.lit(0.001), share, F.lit(0.02)).alias("pad")), 8)


@query("impermanent_loss", "SELECT id, round(2 * sqrt(mid) / (1 + mid) - 1, 8) AS il, round(1 / (1 - sqrt(1 / (1 + 0.3))), 8) AS boost FROM (SELECT id, 0.2 + (id % 40) / 10.0 AS mid FROM pools)")
def _(t):
    return rounded(t.pools.select("id", C.impermanent_loss(0.2 + (F.col("id") % 40) / 10.0).alias("il"), C.concentration(F.lit(0.3)).alias("boost")), 8)


# The pools of one token side by side (stand-in: pairs of one group of brands, aligned on days where all have a bar)
_GROUP = "SELECT substr(pair_address, 1, 7) AS token, pair_address AS pool, day, close FROM bars"


@query("aligned_pools", f"WITH g AS ({_GROUP}), k AS (SELECT token, count(DISTINCT pool) AS np FROM g GROUP BY 1 HAVING count(DISTINCT pool) >= 2) SELECT g.token, g.day, count(*) AS n, round((max(close) - min(close)) / median(close), 6) AS dispersion FROM g JOIN k USING (token) GROUP BY g.token, g.day, np HAVING count(*) = np")
def _(t):
    g = t.sql(_GROUP)
    k = g.groupBy("token").agg(F.count_distinct("pool").alias("np")).where("np >= 2")
    x = g.join(k, "token").groupBy("token", "day", "np").agg(F.count("*").alias("n"), ((F.max("close") - F.min("close")) / F.median("close")).alias("dispersion")).where("n = np")
    return rounded(x.drop("np"))


@query("persisted_arbitrage", f"WITH g AS ({_GROUP}), d AS (SELECT token, day, (max(close) - min(close)) / median(close) AS x FROM g GROUP BY 1, 2 HAVING count(*) >= 2), p AS (SELECT *, lag(x) OVER (PARTITION BY token ORDER BY day) AS before FROM d) SELECT token, count(*) AS n, count(*) FILTER (WHERE before > 0.5) AS fired, round(sum(CASE WHEN before > 0.5 THEN least(before, x) - 0.5 ELSE 0 END), 4) AS captured FROM p GROUP BY 1")
def _(t):
    g = t.sql(_GROUP).groupBy("token", "day").agg(F.count("*").alias("c"), ((F.max("close") - F.min("close")) / F.median("close")).alias("x")).where("c >= 2")
    p = g.withColumn("before", F.lag("x").over(Window.partitionBy("token").orderBy("day")))
    hit = F.col("before") > 0.5
    return rounded(p.groupBy("token").agg(F.count("*").alias("n"), F.count_if(hit).alias("fired"), F.sum(F.when(hit, F.least("before", "x") - 0.5).otherwise(0.0)).alias("captured")), 4)


@query("multi_dex_tokens", "SELECT token, chain, count(*) AS n, count(DISTINCT dex) AS venues FROM pools GROUP BY 1, 2 HAVING count(DISTINCT dex) >= 2")
def _(t):
    return t.pools.groupBy("token", "chain").agg(F.count("*").alias("n"), F.count_distinct("dex").alias("venues")).where("venues >= 2")


@query("coin_of_pair", "SELECT pair_address, CASE WHEN token0 IN ('t0', 't1', 'q0') AND token1 NOT IN ('t0', 't1', 'q0') THEN token1 ELSE token0 END AS coin FROM pool_universe")
def _(t):
    return t.pool_universe.select("pair_address", C.coin_side(F.col("token0"), F.col("token1"), ("t0", "t1", "q0")).alias("coin"))


_VERDICTS = "SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'major_pair' WHEN bool_or(event_type = 'purchase') THEN 'major_cex' ELSE 'dex_only' END AS verdict FROM events GROUP BY 1"


def verdicts(t):
    venue = F.when(F.col("event_type") == "purchase", "kraken").otherwise(F.col("event_type"))
    x = t.events.groupBy("user_id").agg(F.collect_set(venue).alias("venues"))
    base = F.when(F.col("user_id") % 10 == 0, "usdt").otherwise("coin")
    return x.select("user_id", C.venue_verdict(base, F.col("venues"), ("usdt",)).alias("verdict"))


for _name in ("venue_verdicts", "venue_verdicts_all"):  # two names of one query
    query(_name, _VERDICTS)(verdicts)


@query("dex_venues", f"SELECT v, (v ILIKE '%swap%' OR v IN ('Raydium')  OR contains(lower(v), '_v2') OR contains(lower(v), '_v3')) AS dex FROM (SELECT DISTINCT {_VENUE} AS v FROM lineitem)")
def _(t):
    v = t.lineitem.select(F.expr(_VENUE).alias("v")).distinct()
    return v.select("v", C.is_dex(F.col("v")).alias("dex"))


@query("tradeable_gate", "SELECT pair_address, round(reserve_usd, 4) AS reserve_usd FROM meta WHERE reserve_usd >= 60000 AND (parts % 3 <> 0 OR parts >= 80) ORDER BY reserve_usd DESC")
def _(t):
    age = F.when(F.col("parts") % 3 != 0, F.lit(None)).otherwise(F.col("parts"))
    return rounded(t.meta.where((F.col("reserve_usd") >= 60000) & (age.isNull() | (age >= 80))).select("pair_address", "reserve_usd").orderBy(F.desc("reserve_usd")), 4)


@query("name_exclusion", "SELECT p_partkey, p_name FROM part WHERE NOT (split_part(upper(p_name), ' ', 1) LIKE 'RED%' OR split_part(upper(p_name), ' ', 1) LIKE 'SM%')")
def _(t):
    return t.part.where(~C.excluded_name(F.col("p_name"), ("RED", "SM"))).select("p_partkey", "p_name")


@query("coercions", "SELECT event_id, TRY_CAST(x AS DOUBLE) AS num, CASE WHEN TRY_CAST(x AS DOUBLE) IS NULL THEN NULL WHEN TRY_CAST(x AS DOUBLE) > 1 THEN least(TRY_CAST(x AS DOUBLE) / 100, 1) ELSE greatest(TRY_CAST(x AS DOUBLE), 0) END AS frac, CASE WHEN x IN ('1', 'true') THEN true WHEN x IN ('0', 'false') THEN false END AS flag FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '0.25' WHEN 2 THEN '250' WHEN 3 THEN '1' WHEN 4 THEN 'false' ELSE '-3' END AS x FROM events)")
def _(t):
    x = F.expr("CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '0.25' WHEN 2 THEN '250' WHEN 3 THEN '1' WHEN 4 THEN 'false' ELSE '-3' END")
    return t.events.select("event_id", C.to_number(x).alias("num"), C.to_fraction(x).alias("frac"), C.to_flag(x).alias("flag"))


@query("safety_flags", "SELECT user_id, round(list_sum(list_slice(list(v ORDER BY event_id), 1, 10)) / 100, 6) AS top10, bool_or(event_type = 'error') AS honeypot, count(*) FILTER (WHERE event_type = 'error') >= 3 AS high_tax FROM (SELECT user_id, event_id, event_type, round(value, 2) AS v FROM events) GROUP BY 1")
def _(t):
    x = t.events.select("user_id", "event_id", "event_type", F.round("value", 2).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda e: e["v"])
    top = F.aggregate(F.slice(ordered, 1, 10), F.lit(0.0), lambda a, e: a + e) / 100
    return rounded(x.groupBy("user_id").agg(top.alias("top10"), F.bool_or(F.col("event_type") == "error").alias("honeypot"), (F.count_if(F.col("event_type") == "error") >= 3).alias("high_tax")))


@query("gas_enrichment", "SELECT t.log_index, round(r.gas, 9) AS gas_native FROM trades t LEFT JOIN (SELECT event_id, value * 21000 / 1e9 AS gas FROM events WHERE event_id % 2 = 0) r ON r.event_id = t.log_index")
def _(t):
    r = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("log_index"), (F.col("value") * 21000 / 1e9).alias("gas_native"))
    return rounded(t.trades.select("log_index").join(r, "log_index", "left"), 9)


@query("bonding_progress", "SELECT id, round(least(greatest(1 - (reserve_usd - 1000) / 150000, 0), 1), 8) AS progress FROM pools")
def _(t):
    return rounded(t.pools.select("id", A.bonding_progress(F.col("reserve_usd"), F.lit(1000.0), F.lit(150000.0)).alias("progress")), 8)


@query("hex_words", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 1000003 + l_linenumber AS DOUBLE) AS v FROM lineitem")
def _(t):
    v = F.col("l_orderkey") * 1000003 + F.col("l_linenumber")
    data = F.concat(F.lit("0x"), F.lpad(F.hex(v), 64, "0"))
    return t.lineitem.select("l_orderkey", "l_linenumber", A.hex_double(A.word(data, 0)).alias("v"))


@query("dossier", "WITH a AS (SELECT pair_address, count(*) AS n, round(sum(amount_usd), 6) AS volume FROM trades GROUP BY 1), u AS (SELECT pair_address, min(created_sec) AS created_sec FROM pool_universe GROUP BY 1), h AS (SELECT address, count(*) AS snapshots FROM holders GROUP BY 1) SELECT a.pair_address, a.n, a.volume, u.created_sec, h.snapshots FROM a LEFT JOIN u USING (pair_address) LEFT JOIN h ON h.address = a.pair_address")
def _(t):
    a = t.trades.groupBy("pair_address").agg(F.count("*").alias("n"), F.round(F.sum("amount_usd"), 6).alias("volume"))
    u = t.pool_universe.groupBy("pair_address").agg(F.min("created_sec").alias("created_sec"))
    h = t.holders.groupBy(F.col("address").alias("pair_address")).agg(F.count("*").alias("snapshots"))
    return a.join(u, "pair_address", "left").join(h, "pair_address", "left")


@query("cohort_summary", "SELECT p.token0 AS coin, count(DISTINCT t.pair_address) AS pairs, count(t.log_index) AS trades, round(coalesce(sum(t.amount_usd), 0), 6) AS volume, arg_max(t.side, t.sec * 1000000000 + t.log_index) FILTER (WHERE t.side IS NOT NULL) AS last_side FROM pool_universe p LEFT JOIN trades t ON t.pair_address = p.pair_address GROUP BY 1")
def _(t):
    x = t.pool_universe.select(F.col("token0").alias("coin"), "pair_address").join(t.trades.select("pair_address", F.col("pair_address").alias("tp"), "log_index", "sec", "amount_usd", "side"), "pair_address", "left")
    return rounded(x.groupBy("coin").agg(F.count_distinct("tp").alias("pairs"), F.count("log_index").alias("trades"), F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("volume"), M.latest("side", "sec", "log_index").alias("last_side")))
