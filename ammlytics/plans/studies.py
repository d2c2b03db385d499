"""Queries of the studies: regimes, flow signals and selection, next-open and at-age brackets, bootstraps, concentrated liquidity, ML samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.functions.rolling import average_rank, correlation, hash_order, quotient, rolling
from ammlytics.operators import market as M
from ammlytics.operators import research as R
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.plans.research import _IB, _PANEL, _lag, _n, ib, panel
from ammlytics.session import materialised

P = "pair_address"

# Regimes of the equal-weight market
_MKT = f"m AS (SELECT day, avg(close) AS c FROM bars GROUP BY 1), k AS (SELECT *, ln(c / lag(c) OVER (ORDER BY day)) AS lr, row_number() OVER (ORDER BY day) AS k FROM m), g AS (SELECT *, CASE WHEN k >= 50 THEN avg(c) OVER (ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS s50, CASE WHEN k >= 21 THEN stddev_samp(lr) OVER (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS v20 FROM k), h AS (SELECT day, coalesce(lag(c > s50) OVER (ORDER BY day), false) AS up, coalesce(lag(v20 < (SELECT median(v20) FROM g)) OVER (ORDER BY day), false) AS calm FROM g)"


def regimes(t):
    """Per day: was the market above its 50-day mean, and its 20-day volatility below the median, the day before?"""
    o = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    k = t.bars.groupBy("day").agg(F.avg("close").alias("c")).withColumn("lr", F.log(F.col("c") / F.lag("c").over(o)))
    g = k.withColumns({"s50": rolling(F.avg, F.col("c"), o, 50), "v20": rolling(F.stddev_samp, F.col("lr"), o, 20)})
    mid = F.broadcast(g.agg(F.median("v20").alias("mid")))  # one row
    return g.join(mid).select("day", F.coalesce(F.lag(F.col("c") > F.col("s50")).over(o), F.lit(False)).alias("up"), F.coalesce(F.lag(F.col("v20") < F.col("mid")).over(o), F.lit(False)).alias("calm"))


@query("regimes", f"WITH {_MKT} SELECT day, up, calm FROM h")
def _(t):
    return regimes(t)


@query("regime_variants", f"WITH {_MKT}, v AS (SELECT day, unnest(['UNCOND', 'TREND_ON', 'TREND_OFF', 'CALM_ON', 'CALM_OFF', 'BOTH_ON', 'BOTH_OFF']) AS variant, unnest([true, up, NOT up, calm, NOT calm, up AND calm, NOT (up AND calm)]) AS on_ FROM h) SELECT variant, count(*) FILTER (WHERE on_) AS days, count(b.close) FILTER (WHERE on_) AS bars FROM v LEFT JOIN bars b USING (day) GROUP BY 1")
def _(t):
    r = regimes(t)
    on = {"UNCOND": F.lit(True), "TREND_ON": F.col("up"), "TREND_OFF": ~F.col("up"), "CALM_ON": F.col("calm"), "CALM_OFF": ~F.col("calm"), "BOTH_ON": F.col("up") & F.col("calm"), "BOTH_OFF": ~(F.col("up") & F.col("calm"))}
    v = r.select("day", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), x.alias("on")) for k, x in on.items()])).alias("v")).select("day", "v.*")
    return v.join(t.bars.select("day", "close"), "day", "left").groupBy("variant").agg(F.count_if("on").alias("days"), F.count(F.when(F.col("on"), F.col("close"))).alias("bars"))


# Hourly flow signals
_FLOW = "f AS (SELECT pair_address, sec // 3600 AS i, sum(CASE side WHEN 'buy' THEN amount_usd WHEN 'sell' THEN -amount_usd ELSE 0 END) / nullif(sum(CASE WHEN side IS NOT NULL THEN amount_usd END), 0) AS imb, arg_max(coalesce(price_usd, amount_usd), sec * 1000000000 + log_index) AS close FROM trades GROUP BY 1, 2)"


def flow(t):
    sign = F.when(F.col("side") == "buy", F.col("amount_usd")).when(F.col("side") == "sell", -F.col("amount_usd")).otherwise(0.0)
    x = t.trades.withColumn("i", F.floor(F.col("sec") / 3600))
    return x.groupBy(P, "i").agg(F.try_divide(F.sum(sign), F.nullif(F.sum(F.when(F.col("side").isNotNull(), F.col("amount_usd"))), F.lit(0.0))).alias("imb"), F.max_by(F.coalesce("price_usd", "amount_usd"), F.struct("sec", "log_index")).alias("close"))


_FZ = f"WITH {_FLOW}, z AS (SELECT pair_address, i, coalesce(imb, 0) AS x FROM f), s AS (SELECT pair_address, i, {_lag('x')} AS x FROM z), w AS (SELECT pair_address, i, (x - {_n('avg', 'x', 6)}) / nullif({_n('stddev_samp', 'x', 6)}, 0) AS z FROM s)"


@query("flow_signals", f"{_FZ} SELECT pair_address, i, round(z, 6) AS z, coalesce(z > 1, false) AS follow, coalesce(z < -1, false) AS fade FROM w")
def _(t):
    s = flow(t).select(P, "i", F.lag(F.coalesce("imb", F.lit(0.0))).over(R.w()).alias("x"))
    z = F.try_divide(F.col("x") - rolling(F.avg, F.col("x"), R.w(), 6), F.nullif(rolling(F.stddev_samp, F.col("x"), R.w(), 6), F.lit(0.0)))
    w = s.select(P, "i", z.alias("z"))
    return rounded(w.select(P, "i", "z", F.coalesce(F.col("z") > 1, F.lit(False)).alias("follow"), F.coalesce(F.col("z") < -1, F.lit(False)).alias("fade")))


@query("flow_predicts", f"WITH {_FLOW}, n AS (SELECT pair_address, imb, lead(close, 1) OVER (PARTITION BY pair_address ORDER BY i) / close - 1 AS fwd FROM f WHERE imb IS NOT NULL), v AS (SELECT * FROM n WHERE fwd IS NOT NULL), a AS (SELECT pair_address, rank() OVER (PARTITION BY pair_address ORDER BY imb) + (count(*) OVER (PARTITION BY pair_address, imb) - 1) / 2.0 AS x, rank() OVER (PARTITION BY pair_address ORDER BY fwd) + (count(*) OVER (PARTITION BY pair_address, fwd) - 1) / 2.0 AS y FROM v), c AS (SELECT pair_address, corr(x, y) AS ic, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 20) SELECT count(*) AS pairs, round(avg(ic), 6) AS mean, round(median(ic), 6) AS median FROM c")
def _(t):
    v = flow(t).where("imb is not null").withColumn("fwd", quotient(F.lead("close").over(R.w()), F.col("close")) - 1).where("fwd is not null")
    a = v.select(P, average_rank(F.col("imb"), [P]).alias("x"), average_rank(F.col("fwd"), [P]).alias("y"))
    c = a.groupBy(P).agg(correlation("x", "y").alias("ic"), F.count("*").alias("n")).where("n >= 20")
    return c.agg(F.count("*").alias("pairs"), F.round(F.avg("ic"), 6).alias("mean"), F.round(F.median("ic"), 6).alias("median"))


@query("flow_selection", "WITH d AS (SELECT pair_address, sec // 86400 AS i, sum(CASE side WHEN 'buy' THEN amount_usd WHEN 'sell' THEN -amount_usd ELSE 0 END) AS net, count(DISTINCT maker) FILTER (WHERE side = 'buy') AS buyers, avg(price_usd) AS close FROM trades GROUP BY 1, 2), s AS (SELECT pair_address, i, lag(net) OVER w AS sig, lead(close) OVER w / close - 1 AS fwd FROM d WINDOW w AS (PARTITION BY pair_address ORDER BY i)), a AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sig DESC, pair_address) AS r, count(*) OVER (PARTITION BY i) AS n FROM s WHERE sig IS NOT NULL AND fwd IS NOT NULL) SELECT i, count(*) AS k, round(avg(fwd), 6) AS ret FROM a WHERE r <= 5 AND n >= 10 GROUP BY 1")
def _(t):
    sign = F.when(F.col("side") == "buy", F.col("amount_usd")).when(F.col("side") == "sell", -F.col("amount_usd")).otherwise(0.0)
    d = t.trades.withColumn("i", F.floor(F.col("sec") / 86400)).groupBy(P, "i").agg(F.sum(sign).alias("net"), F.avg("price_usd").alias("close"))
    s = d.select(P, "i", F.lag("net").over(R.w()).alias("sig"), (quotient(F.lead("close").over(R.w()), F.col("close")) - 1).alias("fwd")).where("fwd is not null")
    return rounded(R.top_k(s, "i", F.col("sig"), 5).groupBy("i").agg(F.count("*").alias("k"), F.avg("fwd").alias("ret")))


@query("count_flow_features", "WITH d AS (SELECT pair_address, sec // 86400 AS i, count(*) FILTER (WHERE side = 'buy') AS b, count(*) FILTER (WHERE side = 'sell') AS s, count(DISTINCT maker) FILTER (WHERE side = 'buy') AS tb FROM trades GROUP BY 1, 2) SELECT pair_address, i, round(CAST(b - s AS DOUBLE) / nullif(b + s, 0), 6) AS tx_imb, round(sum(tb) OVER (PARTITION BY pair_address ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / CAST(nullif(sum(tb) OVER (PARTITION BY pair_address ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS DOUBLE), 6) AS growth FROM d")
def _(t):
    d = t.trades.withColumn("i", F.floor(F.col("sec") / 86400)).groupBy(P, "i").agg(F.count_if(F.col("side") == "buy").alias("b"), F.count_if(F.col("side") == "sell").alias("s"), F.count_distinct(F.when(F.col("side") == "buy", F.col("maker"))).alias("tb"))
    w3, w10 = R.w().rowsBetween(-2, 0), R.w().rowsBetween(-9, 0)
    return rounded(d.select(P, "i", F.try_divide((F.col("b") - F.col("s")).cast("double"), F.nullif((F.col("b") + F.col("s")).cast("double"), F.lit(0.0))).alias("tx_imb"), F.try_divide(F.sum("tb").over(w3).cast("double"), F.nullif(F.sum("tb").over(w10).cast("double"), F.lit(0.0))).alias("growth")))


@query("single_best_with_switch_cost", f"WITH {_IB}, r AS (SELECT pair_address, day, close / {_lag('close')} - 1 AS r, i FROM ib), f AS (SELECT pair_address, day, {_lag('tr6')} AS sig, r FROM (SELECT *, {_n('avg', 'r', 6, 3)} AS tr6 FROM r)), b AS (SELECT day, arg_max(pair_address, (sig, pair_address)) AS pick FROM f WHERE sig IS NOT NULL GROUP BY 1), p AS (SELECT day, pick, lag(pick) OVER (ORDER BY day) AS before FROM b) SELECT p.day, pick, round(f.r - CASE WHEN before IS DISTINCT FROM pick THEN 0.016 ELSE 0 END, 6) AS net FROM p JOIN f ON f.day = p.day AND f.pair_address = p.pick")
def _(t):
    r = R.numbered(t.bars).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1)
    f = r.withColumn("m", rolling(F.avg, F.col("r"), R.w(), 6, 3)).withColumn("sig", F.lag("m").over(R.w()))
    pick = f.where("sig is not null").groupBy("day").agg(F.max_by(P, F.struct("sig", P)).alias("pick"))
    o = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    pick = pick.withColumn("cost", F.when(F.lag("pick").over(o).eqNullSafe(F.col("pick")), 0.0).otherwise(0.016))
    return rounded(pick.join(f.select("day", F.col(P).alias("pick"), "r"), ["day", "pick"]).select("day", "pick", (F.col("r") - F.col("cost")).alias("net")))


# Entries
@query("next_open_bracket", f"WITH {_IB}, s AS (SELECT pair_address, i + 1 AS i FROM (SELECT pair_address, i, close > {_lag('close')} * 1.3 AS up FROM ib) WHERE up), e AS (SELECT a.pair_address, a.i, a.open FROM ib a JOIN s USING (pair_address, i)), h AS (SELECT e.pair_address, e.i, e.open, min(b.i) AS hit, min(b.i) FILTER (WHERE b.low <= e.open * 0.9) AS stop FROM e LEFT JOIN ib b ON b.pair_address = e.pair_address AND b.i BETWEEN e.i AND e.i + 4 AND (b.low <= e.open * 0.9 OR b.high >= e.open * 1.15) GROUP BY ALL) SELECT pair_address, i, CASE WHEN hit IS NULL THEN 'time' WHEN hit = stop THEN 'sl' ELSE 'tp' END AS how FROM h")
def _(t):
    b = R.numbered(t.bars)
    e = b.withColumn("up", F.col("close") > F.lag("close").over(R.w()) * 1.3).withColumn("go", F.lag("up").over(R.w()))
    ahead = R.w().rowsBetween(0, 4)
    # bars from the entry bar on: a bounded frame, no join
    e = e.withColumn("path", F.collect_list(F.struct("low", "high")).over(ahead)).where("go")
    stop = F.expr("array_position(transform(path, x -> x.low <= open * 0.9D), true)")
    goal = F.expr("array_position(transform(path, x -> x.high >= open * 1.15D), true)")
    how = F.when((stop == 0) & (goal == 0), "time").when((stop > 0) & ((goal == 0) | (stop <= goal)), "sl").otherwise("tp")
    return e.select(P, "i", how.alias("how"))


@query("entry_at_age", f"WITH {_IB}, e AS (SELECT pair_address, close FROM ib WHERE i = 10), h AS (SELECT e.pair_address, min(b.i) FILTER (WHERE b.low <= e.close * 0.7) AS sl, min(b.i) FILTER (WHERE b.high >= e.close * 1.5) AS tp, arg_max(b.close, b.i) AS last, max(e.close) AS ep FROM e JOIN ib b ON b.pair_address = e.pair_address AND b.i BETWEEN 11 AND 40 GROUP BY 1) SELECT pair_address, round(CASE WHEN sl IS NOT NULL AND sl <= coalesce(tp, sl) THEN -0.3 WHEN tp IS NOT NULL THEN 0.5 ELSE last / ep - 1 END, 6) AS ret FROM h")
def _(t):
    b = R.numbered(t.bars).withColumn("ep", F.max(F.when(F.col("i") == 10, F.col("close"))).over(Window.partitionBy(P))).where("i between 11 and 40 and ep is not null")
    g = b.groupBy(P).agg(F.min(F.when(F.col("low") <= F.col("ep") * 0.7, F.col("i"))).alias("sl"), F.min(F.when(F.col("high") >= F.col("ep") * 1.5, F.col("i"))).alias("tp"), F.max_by("close", "i").alias("last"), F.max("ep").alias("ep"))
    return rounded(g.select(P, F.when(F.col("sl").isNotNull() & (F.col("sl") <= F.coalesce("tp", "sl")), F.lit(-0.3)).when(F.col("tp").isNotNull(), F.lit(0.5)).otherwise(F.col("last") / F.col("ep") - 1).alias("ret")))


@query("skip_first_bars", f"WITH {_IB} SELECT s AS skip, count(*) AS n, round(avg(close), 6) AS close FROM ib, (VALUES (0), (3), (7), (14), (21)) v(s) WHERE i >= s GROUP BY 1")
def _(t):
    x = R.numbered(t.bars).withColumn("skip", F.explode(F.array(*[F.lit(k) for k in (0, 3, 7, 14, 21)])))
    return rounded(x.where("i >= skip").groupBy("skip").agg(F.count("*").alias("n"), F.avg("close").alias("close")))


@query("calendar_split", "WITH q AS (SELECT min(day) AS lo, max(day) AS hi FROM bars) SELECT CASE WHEN day - lo < 0.6 * (hi - lo) THEN 'is' ELSE 'oos' END AS part, count(*) AS n, round(avg(close), 6) AS close FROM bars, q GROUP BY 1")
def _(t):
    q = F.broadcast(t.bars.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))  # one row
    part = F.when(F.datediff("day", "lo") < 0.6 * F.datediff("hi", "lo"), "is").otherwise("oos")
    return rounded(t.bars.join(q).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("close").alias("close")))


@query("pair_folds", "SELECT pair_address, CAST((row_number() OVER (ORDER BY first, pair_address) - 1) * 5 // count(*) OVER () AS BIGINT) AS fold FROM (SELECT pair_address, min(day) AS first FROM bars GROUP BY 1)")
def _(t):
    x = t.bars.groupBy(P).agg(F.min("day").alias("first"))
    return R.folds(x, ["first", P], 5).select(P, "fold")


@query("penalised_objective", "SELECT n, round(1 + n / (n + 10.0) * (least(n / 7.0, 10) - 1), 6) AS score FROM (SELECT DISTINCT n FROM bars)")
def _(t):
    return rounded(t.bars.select("n").distinct().select("n", R.penalised(F.col("n") / 7.0, F.col("n").cast("double")).alias("score")))


# Resampling by hash, equal in both engines
@query("bootstrap_mean", "WITH d AS (SELECT day, avg(close) AS c, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM bars GROUP BY 1), s AS (SELECT r, d.k, CAST(concat('0x', substr(md5(concat_ws('|', 'boot', CAST(r AS STRING), CAST(d.k AS STRING))), 1, 12)) AS BIGINT) % n AS pick FROM d, range(0, 2000) t(r)), m AS (SELECT r, avg(d.c) AS m FROM s JOIN d ON d.k = s.pick GROUP BY 1) SELECT count(*) AS reps, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m")
def _(t):
    o = Window.partitionBy(F.lit(0))  # one row a day
    d = t.bars.groupBy("day").agg(F.avg("close").alias("c")).select("c", (F.row_number().over(o.orderBy("day")) - 1).alias("k"), F.count("*").over(o).alias("n"))
    s = d.select(F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("r"), "k", "n").withColumn("pick", F.conv(F.substring(hash_order("boot", F.col("r"), F.col("k")), 1, 12), 16, 10).cast("long") % F.col("n"))
    m = s.select("r", F.col("pick").alias("k")).join(d.select("k", "c"), "k").groupBy("r").agg(F.avg("c").alias("m"))
    return m.agg(F.count("*").alias("reps"), F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi"))


# Liquidity providing in a band: re-centred when the price leaves it (a fold over each pair's ordered closes)
_LP = "l AS (SELECT pair_address, i, close AS c, close AS mid, 0 AS moves, CAST(0 AS DOUBLE) AS il FROM ib WHERE i = 0 UNION ALL SELECT b.pair_address, b.i, b.close, CASE WHEN b.close > l.mid * 1.3 OR b.close < l.mid / 1.3 THEN b.close ELSE l.mid END, l.moves + CASE WHEN b.close > l.mid * 1.3 OR b.close < l.mid / 1.3 THEN 1 ELSE 0 END, l.il + CASE WHEN b.close > l.mid * 1.3 OR b.close < l.mid / 1.3 THEN 2 * sqrt(b.close / l.mid) / (1 + b.close / l.mid) - 1 ELSE 0 END FROM l JOIN ib b ON b.pair_address = l.pair_address AND b.i = l.i + 1)"


_CONCENTRATED = f"WITH RECURSIVE {_IB}, {_LP} SELECT pair_address, CAST(max(moves) AS BIGINT) AS moves, round(arg_max(il, i), 6) AS il FROM l GROUP BY 1"


def concentrated(bars):
    a = bars.groupBy(P).agg(F.array_sort(F.collect_list(F.struct("i", "close"))).alias("s"))
    fold = F.expr("""aggregate(slice(s, 2, size(s)), struct(s[0].close as mid, 0L as moves, 0D as il),
        (acc, x) -> if(x.close > acc.mid * 1.3D or x.close < acc.mid / 1.3D, struct(x.close as mid, acc.moves + 1L as moves, acc.il + 2D * sqrt(x.close / acc.mid) / (1D + x.close / acc.mid) - 1D as il), acc))""")
    return rounded(a.select(P, fold.alias("x")).select(P, "x.moves", "x.il"))


for _name in ("lp_concentrated", "lp_concentrated_all"):  # two names of one query
    query(_name, _CONCENTRATED)(lambda t: concentrated(R.numbered(t.bars)))


@query("lp_random_null", "WITH y AS (SELECT pair_address, sum(volume) AS v FROM bars GROUP BY 1), s AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', 'lp', CAST(k AS STRING), pair_address)), pair_address) AS r FROM y, range(0, 25) t(k)) SELECT k, round(sum(v), 2) AS v FROM s WHERE r <= 5 GROUP BY 1")
def _(t):
    y = t.bars.groupBy(P).agg(F.sum("volume").alias("v"))
    s = y.select(P, "v", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(hash_order("lp", F.col("k"), F.col(P)), P)))
    return rounded(s.where("r <= 5").groupBy("k").agg(F.sum("v").alias("v")), 2)


@query("rebalance_grid", f"WITH {_PANEL} SELECT step, count(*) AS n, round(avg(fwd), 6) AS fwd FROM g, (VALUES (1), (3), (7), (14)) v(step) WHERE fwd IS NOT NULL AND d % step = 0 GROUP BY 1")
def _(t):
    x = panel(t).where("fwd is not null").withColumn("step", F.explode(F.array(*[F.lit(k) for k in (1, 3, 7, 14)])))
    return rounded(x.where("d % step = 0").groupBy("step").agg(F.count("*").alias("n"), F.avg("fwd").alias("fwd")))


@query("survivor_attribution", "WITH x AS (SELECT pair_address, arg_max(close, day) / arg_min(close, day) - 1 AS total FROM bars GROUP BY 1) SELECT total > -0.5 AS survivor, count(*) AS n, round(avg(total), 6) AS total FROM x GROUP BY 1")
def _(t):
    x = t.bars.groupBy(P).agg((F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("total"))
    return rounded(x.groupBy((F.col("total") > -0.5).alias("survivor")).agg(F.count("*").alias("n"), F.avg("total").alias("total")))


@query("is_direction", f"WITH {_PANEL}, a AS (SELECT d, fwd, row_number() OVER (PARTITION BY d ORDER BY mom DESC, pair_address) AS hi, row_number() OVER (PARTITION BY d ORDER BY mom ASC, pair_address) AS lo, avg(fwd) OVER (PARTITION BY d) AS bench FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL AND d < 3000), e AS (SELECT 'high' AS direction, avg(fwd - bench) AS edge FROM a WHERE hi <= 3 UNION ALL SELECT 'low', avg(fwd - bench) FROM a WHERE lo <= 3) SELECT direction, round(edge, 6) AS edge FROM e ORDER BY edge DESC, direction LIMIT 1")
def _(t):
    x = panel(t).where("mom is not null and fwd is not null and d < 3000")
    d = Window.partitionBy("d")
    x = x.withColumns({"hi": F.row_number().over(d.orderBy(F.desc("mom"), P)), "lo": F.row_number().over(d.orderBy(F.asc("mom"), P)), "edge": F.col("fwd") - F.avg("fwd").over(d)})
    e = x.select(F.explode(F.array(F.struct(F.lit("high").alias("direction"), (F.col("hi") <= 3).alias("on")), F.struct(F.lit("low").alias("direction"), (F.col("lo") <= 3).alias("on")))).alias("s"), "edge").where("s.on")
    return rounded(e.groupBy(F.col("s.direction").alias("direction")).agg(F.avg("edge").alias("edge"))).orderBy(F.desc("edge"), "direction").limit(1)


@query("unpivoted_results", "SELECT pair_address, unnest(['open', 'close']) AS field, round(unnest([avg(open), avg(close)]), 6) AS v FROM bars GROUP BY 1")
def _(t):
    g = t.bars.groupBy(P).agg(F.avg("open").alias("o"), F.avg("close").alias("c"))
    return rounded(g.selectExpr(P, "stack(2, 'open', o, 'close', c) as (field, v)"))


_DENSE = "SELECT d.day, p.pair_address, round(coalesce(b.volume, 0), 4) AS volume FROM (SELECT DISTINCT day FROM bars) d CROSS JOIN (SELECT DISTINCT pair_address FROM bars) p LEFT JOIN bars b ON b.day = d.day AND b.pair_address = p.pair_address"


def dense(t):
    # a pair's row is unfolded to the days of the calendar (one array of at most a few thousand days), not crossed with a table
    edge = t.bars.agg(F.array_sort(F.collect_set("day")).alias("days"))  # one row
    grid = t.bars.select(P).distinct().join(F.broadcast(edge)).select(P, F.explode("days").alias("day"))
    return rounded(grid.join(t.bars.select("day", P, "volume"), ["day", P], "left").select("day", P, F.coalesce("volume", F.lit(0.0)).alias("volume")), 4)


for _name in ("dense_panel", "dense_panel_all"):  # two names of one query
    query(_name, _DENSE)(dense)


@query("interval_weights", "WITH w AS (SELECT pair_address, date_trunc('month', day) AS s, date_trunc('month', day) + INTERVAL 1 MONTH AS e, count(*) AS wt FROM bars GROUP BY ALL) SELECT b.pair_address, b.day, w.wt FROM bars b JOIN w ON w.pair_address = b.pair_address AND b.day >= w.s AND b.day < w.e")
def _(t):
    month = F.trunc("day", "month")
    w = t.bars.groupBy(F.col(P).alias("wp"), month.alias("s")).agg(F.count("*").alias("wt")).withColumn("e", F.add_months("s", 1))
    b = t.bars.select(P, "day")
    return b.join(w, (F.col(P) == F.col("wp")) & (F.col("s") == month) & (F.col("day") < F.col("e"))).select(P, "day", "wt")


@query("real_and_null_side_by_side", "WITH r AS (SELECT pair_address, avg(close) AS a, count(*) AS n FROM bars GROUP BY 1), z AS (SELECT pair_address, avg(open) AS a, count(*) AS n FROM bars GROUP BY 1) SELECT pair_address, round(r.a, 6) AS a_real, round(z.a, 6) AS a_null, round(r.a - z.a, 6) + 0.0 AS gap FROM r JOIN z USING (pair_address)")
def _(t):
    r, z = t.bars.groupBy(P).agg(F.avg("close").alias("a_real")), t.bars.groupBy(P).agg(F.avg("open").alias("a_null"))
    return r.join(z, P).select(P, F.round("a_real", 6).alias("a_real"), F.round("a_null", 6).alias("a_null"), (F.round(F.col("a_real") - F.col("a_null"), 6) + F.lit(0.0)).alias("gap"))


@query("static_flow_features", "SELECT pair_address, round(sum(CASE side WHEN 'buy' THEN amount_usd WHEN 'sell' THEN -amount_usd ELSE 0 END) / nullif(sum(amount_usd), 0), 6) AS net_ratio, round(ln(1 + sum(amount_usd)), 6) AS log_total FROM trades GROUP BY 1")
def _(t):
    sign = F.when(F.col("side") == "buy", F.col("amount_usd")).when(F.col("side") == "sell", -F.col("amount_usd")).otherwise(0.0)
    return rounded(t.trades.groupBy(P).agg((F.sum(sign) / F.nullif(F.sum("amount_usd"), F.lit(0.0))).alias("net_ratio"), F.log1p(F.sum("amount_usd")).alias("log_total")))


@query("ml_sample", f"WITH {_IB}, f AS (SELECT pair_address, day, i, {_lag('close')} / {_lag('close', 6)} - 1 AS ret5, lead(close, 7) OVER (PARTITION BY pair_address ORDER BY i) / close - 1 AS y FROM ib), a AS (SELECT *, count(*) OVER (PARTITION BY day) AS alive FROM f WHERE i >= 60 AND i % 7 = 0 AND y IS NOT NULL) SELECT pair_address, day, round(ret5, 6) AS ret5, round(y, 6) AS y FROM a WHERE alive >= 3")
def _(t):
    f = R.numbered(t.bars).select(P, "day", "i", (F.lag("close").over(R.w()) / F.lag("close", 6).over(R.w()) - 1).alias("ret5"), (F.lead("close", 7).over(R.w()) / F.col("close") - 1).alias("y"))
    a = f.where("i >= 60 and i % 7 = 0 and y is not null").withColumn("alive", F.count("*").over(Window.partitionBy("day")))
    return rounded(a.where("alive >= 3").select(P, "day", "ret5", "y"))


@query("ml_ranker")
def _(t):
    """Boosted trees on the features of the first part of the calendar (medians filled in), scored by rank correlation on the rest."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    f = R.numbered(t.bars)
    x = f.select(P, "day", "i", (F.lag("close").over(R.w()) / F.lag("close", 6).over(R.w()) - 1).alias("ret5"), (F.lag("close").over(R.w()) / F.lag("close", 21).over(R.w()) - 1).alias("ret20"), (F.lead("close", 7).over(R.w()) / F.col("close") - 1).alias("y"))
    x = x.where("i >= 30 and i % 7 = 0 and y is not null")
    # written once: the trees, the medians and both parts read it many times, and each time all lines would be joined and sorted again
    x = materialised(x.withColumn("label", average_rank(F.col("y"), ["day"]) / F.count("*").over(Window.partitionBy("day"))))
    train, test = x.where("day < date'1999-01-01'"), x.where("day >= date'1999-01-01'")
    if train.isEmpty() or test.isEmpty():  # nothing to learn from, or nothing to score
        return t.spark.createDataFrame([], "day date, ic double, n long")
    cols = ["ret5", "ret20"]
    imputer = Imputer(strategy="median", inputCols=cols, outputCols=[f"{c}_f" for c in cols]).fit(train)
    assembler = VectorAssembler(inputCols=[f"{c}_f" for c in cols], outputCol="features")
    model = GBTRegressor(labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(assembler.transform(imputer.transform(train)))
    scored = model.transform(assembler.transform(imputer.transform(test)))
    r = scored.select("day", average_rank(F.col("prediction"), ["day"]).alias("p"), average_rank(F.col("y"), ["day"]).alias("r"))
    return r.groupBy("day").agg(correlation("p", "r").alias("ic"), F.count("*").alias("n")).where("n >= 5 and ic is not null")


# Normalisers of landed responses
_JSON = "concat('{\"price\": \"', CAST(value AS STRING), '\", \"kind\": \"', event_type, '\", \"pct\": ', CAST(event_id % 200 AS STRING), '}')"


@query("landed_json", "SELECT event_id, round(value, 6) AS price, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'sell' END AS side, round(CASE WHEN event_id % 200 > 1 THEN least((event_id % 200) / 100.0, 1) ELSE event_id % 200 END, 6) AS frac FROM events")
def _(t):
    m = F.from_json(F.expr(_JSON), "price STRING, kind STRING, pct STRING")
    x = t.events.select("event_id", m.alias("m"))
    side = F.when(F.col("m.kind") == "purchase", "buy").when(F.col("m.kind") == "view", "sell")
    return rounded(x.select("event_id", C.to_number(F.col("m.price")).alias("price"), side.alias("side"), C.to_fraction(F.col("m.pct")).alias("frac")))


@query("listed_bars", "SELECT user_id, sec, round(v, 6) AS close FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS sec, arg_max(value, ts) AS v FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2)")
def _(t):
    # rows land as one array for each user; inline() gives bars, those without a close are dropped, one bar a day stays
    landed = t.events.groupBy("user_id").agg(F.collect_list(F.struct("ts", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("close"))).alias("rows"))
    b = landed.select("user_id", F.inline("rows")).where("close is not null").withColumn("sec", F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 86400))
    return rounded(b.groupBy("user_id", "sec").agg(F.max_by("close", "ts").alias("close")))


@query("normal_addresses", "SELECT pair_address, CASE WHEN chain = 'solana' THEN upper(pair_address) ELSE lower(upper(pair_address)) END AS address, count(*) AS n FROM trades GROUP BY 1, 2")
def _(t):
    x = t.trades.select("pair_address", C.normal_address(F.col("chain"), F.upper("pair_address")).alias("address"))
    return x.groupBy("pair_address", "address").agg(F.count("*").alias("n"))


@query("available_sources", "SELECT user_id, bool_or(event_type = 'error') AS bad, count(DISTINCT event_type) AS sources FROM events WHERE event_type <> 'signup' GROUP BY 1")
def _(t):
    kinds = ("purchase", "view", "click", "error")
    parts = [t.events.where(F.col("event_type") == k).select("user_id", F.lit(k).alias("source"), F.lit(k == "error").alias("bad")) for k in kinds]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy("user_id").agg(F.bool_or("bad").alias("bad"), F.count_distinct("source").alias("sources"))


@query("top_accounts", "SELECT token, holder, round(share, 6) AS share FROM (SELECT token, dst AS holder, sum(value) / CAST(sum(sum(value)) OVER (PARTITION BY token) AS DOUBLE) AS share, row_number() OVER (PARTITION BY token ORDER BY sum(value) DESC, dst) AS r FROM transfers GROUP BY 1, 2) WHERE r <= 20")
def _(t):
    g = t.transfers.groupBy("token", F.col("dst").alias("holder")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("token")
    x = g.withColumns({"share": F.col("v") / F.sum("v").over(w), "r": F.row_number().over(w.orderBy(F.desc("v"), "holder"))})
    return rounded(x.where("r <= 20").select("token", "holder", "share"))


@query("block_clock", "WITH s AS (SELECT min(block_number) AS b0, max(block_number) AS b1, min(sec) AS s0, max(sec) AS s1 FROM trades) SELECT DISTINCT block_number, CAST(round(s0 + (block_number - b0) * (s1 - s0) / CAST(b1 - b0 AS DOUBLE)) AS BIGINT) AS sec FROM trades, s")
def _(t):
    s = F.broadcast(t.trades.agg(F.min("block_number").alias("b0"), F.max("block_number").alias("b1"), F.min("sec").alias("s0"), F.max("sec").alias("s1")))  # one row
    x = t.trades.select("block_number").distinct().join(s)
    return x.select("block_number", F.round(F.col("s0") + (F.col("block_number") - F.col("b0")) * (F.col("s1") - F.col("s0")) / (F.col("b1") - F.col("b0"))).cast("long").alias("sec"))


@query("wallet_flow_by_transaction", "SELECT block, sum(CASE WHEN v > 0 THEN v ELSE 0 END)::BIGINT AS inflow, sum(CASE WHEN v < 0 THEN -v ELSE 0 END)::BIGINT AS outflow FROM (SELECT block, sum(v) AS v FROM (SELECT block, dst AS w, value AS v FROM transfers UNION ALL SELECT block, src, -value FROM transfers) WHERE w = 'a7' GROUP BY block) GROUP BY 1")
def _(t):
    delta = F.when(F.col("dst") == "a7", F.col("value")).otherwise(0) - F.when(F.col("src") == "a7", F.col("value")).otherwise(0)
    x = t.transfers.where("dst = 'a7' or src = 'a7'").groupBy("block").agg(F.sum(delta).alias("v"))
    return x.select("block", F.greatest("v", F.lit(0)).alias("inflow"), F.greatest(-F.col("v"), F.lit(0)).alias("outflow"))


@query("deepest_pool", "SELECT token, arg_max(pool, (coalesce(reserve_usd, fee_bps), id)) AS pool FROM pools GROUP BY 1")
def _(t):
    return t.pools.groupBy("token").agg(F.max_by("pool", F.struct(F.coalesce("reserve_usd", F.col("fee_bps").cast("double")), "id")).alias("pool"))


@query("coins_per_chain", "SELECT chain, pair_address FROM (SELECT chain, pair_address, row_number() OVER (PARTITION BY chain ORDER BY count(*) DESC, pair_address) AS r FROM trades GROUP BY 1, 2 HAVING count(*) >= 10) WHERE r <= 25")
def _(t):
    x = t.trades.groupBy("chain", P).agg(F.count("*").alias("n")).where("n >= 10")
    return M.first_of_key(x, ["chain", P], F.lit(1)).withColumn("r", F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("n"), P))).where("r <= 25").select("chain", P)
