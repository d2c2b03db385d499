"""Queries that hold a result against its control: hedged against plain, after cost, in a regime, by objective, by split, against a shuffled null."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.functions.ordered import quantiles, running
from ammlytics.functions.rolling import hash_order
from ammlytics.operators import combos as O
from ammlytics.operators import research as R
from ammlytics.plans.amm import _GAS, _GROUP, _round_trip
from ammlytics.plans.evaluation import _F13, features
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.plans.research import _IB, _PANEL, _RET, P, _lag, _n, _sim_sql, daily_returns, ib, panel
from ammlytics.plans.studies import _MKT, regimes
from ammlytics.session import materialised

# Hedge ------------------------------------------------------------------------------------------------------------------------
IS_DAYS, OOS_DAYS, REBALANCE = 60, 21, 7
FUNDING, TAKER = 0.0003, 0.0005
_METRICS = """SELECT {keys}, n, round(l * 365 / n, 4) AS ann_log, round(sd * sqrt(365), 4) AS ann_vol, round(mu * 365 / nullif(sd * sqrt(365), 0), 4) AS sharpe, round(dd, 4) AS max_dd
 FROM (SELECT {keys}, count(*) AS n, sum(ln(1 + r)) AS l, avg(r) AS mu, stddev_samp(r) AS sd, min(dd) AS dd FROM (SELECT *, e / max(e) OVER (PARTITION BY {keys} ORDER BY day) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {keys} ORDER BY day)) AS e FROM {daily})) GROUP BY {keys})"""


@query("hedged_basket", f"""WITH {_IB}, {_RET}, x AS (SELECT pair_address, day, r, reserve_usd FROM r JOIN meta USING (pair_address) WHERE r IS NOT NULL), mk AS (SELECT day, r AS m FROM x WHERE pair_address = (SELECT min(pair_address) FROM x)),
bk AS (SELECT 'equal' AS weight, day, avg(r) AS g FROM x GROUP BY day UNION ALL SELECT 'reserve', day, sum(r * reserve_usd) / sum(reserve_usd) FROM x GROUP BY day),
nk AS (SELECT weight, day, g - CASE WHEN (row_number() OVER (PARTITION BY weight ORDER BY day) - 1) % 7 = 0 THEN 0.0151 ELSE 0 END AS net FROM bk),
c AS (SELECT weight, day, net, m, row_number() OVER (PARTITION BY weight ORDER BY day) - 1 AS k FROM nk JOIN mk USING (day)),
b AS (SELECT *, covar_samp(net, m) OVER w AS cv, var_pop(m) OVER w AS vp FROM c WINDOW w AS (PARTITION BY weight ORDER BY k ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
be AS (SELECT weight, (k - 60) // 21 AS win, CASE WHEN round(vp, 12) > 0 THEN least(greatest(cv / vp, -3), 3) ELSE 0 END AS beta FROM b WHERE k >= 60 AND (k - 60) % 21 = 0),
o AS (SELECT c.weight, c.day, c.net, c.net - beta * m - abs(beta) * {FUNDING} - CASE WHEN k % 7 = 0 THEN abs(beta) * {TAKER} ELSE 0 END AS hedged FROM c JOIN be ON be.weight = c.weight AND be.win = (k - 60) // 21 WHERE k >= 60),
d AS (SELECT weight, 'plain' AS variant, day, net AS r FROM o UNION ALL SELECT weight, 'hedged', day, hedged FROM o) {_METRICS.format(keys='weight, variant', daily='d')}""")
def _(t):
    """A basket rebalanced weekly, as it is and with its market exposure sold: the exposure is measured on 60 days and hedged on the next 21, for funding each day and a fee each week."""
    x = materialised(daily_returns(t).join(t.meta.select(P, "reserve_usd"), P))
    market = x.join(F.broadcast(x.agg(F.min(P).alias(P))), P).select("day", F.col("r").alias("m"))  # one row
    g = x.groupBy("day").agg(F.avg("r").alias("equal"), (F.sum(F.col("r") * F.col("reserve_usd")) / F.sum("reserve_usd")).alias("reserve"))
    g = g.select("day", F.expr("stack(2, 'equal', equal, 'reserve', reserve) as (weight, g)"))
    w = Window.partitionBy("weight").orderBy("day")  # a row a day
    net = g.select("weight", "day", (F.col("g") - F.when((F.row_number().over(w) - 1) % REBALANCE == 0, 0.0151).otherwise(0.0)).alias("net"))
    c = net.join(market, "day").withColumn("k", F.row_number().over(w) - 1)
    past = w.rowsBetween(-IS_DAYS, -1)
    c = c.withColumns({"cv": F.covar_samp("net", "m").over(past), "vp": F.var_pop("m").over(past), "win": F.floor((F.col("k") - IS_DAYS) / OOS_DAYS)}).where(F.col("k") >= IS_DAYS)
    slope = F.when(F.round("vp", 12) > 0, F.least(F.greatest(F.try_divide("cv", "vp"), F.lit(-3.0)), F.lit(3.0))).otherwise(0.0)
    beta = F.max(F.when((F.col("k") - IS_DAYS) % OOS_DAYS == 0, slope)).over(Window.partitionBy("weight", "win"))
    c = c.withColumn("beta", beta)
    hedged = F.col("net") - F.col("beta") * F.col("m") - F.abs("beta") * FUNDING - F.when(F.col("k") % REBALANCE == 0, F.abs("beta") * TAKER).otherwise(0.0)
    d = c.select("weight", "day", F.col("net").alias("plain"), hedged.alias("hedged")).select("weight", "day", F.expr("stack(2, 'plain', plain, 'hedged', hedged) as (variant, r)"))
    m = R.metrics(d, ["weight", "variant"], "day", "r", geometric=True)
    return rounded(m.select("weight", "variant", "n", F.log1p("ann_ret").alias("ann_log"), "ann_vol", "sharpe", "max_dd"), 4)


# Dispersion after cost --------------------------------------------------------------------------------------------------------
_COST = _round_trip("greatest(50, 0.0025 * reserve_usd)", "reserve_usd", "30", _GAS.format("chain"))


@query("arbitrage_after_cost", f"""WITH g AS ({_GROUP}), np AS (SELECT token, count(DISTINCT pool) AS np FROM g GROUP BY 1 HAVING count(DISTINCT pool) >= 2), al AS (SELECT token, day FROM g JOIN np USING (token) GROUP BY token, day, np HAVING count(*) = np),
a AS (SELECT token, pool, day, close, row_number() OVER (PARTITION BY token, pool ORDER BY day) AS k, row_number() OVER (PARTITION BY token, pool ORDER BY md5(concat_ws('|', 'arb', pool, CAST(day AS STRING))), day) AS h FROM g JOIN al USING (token, day)),
s AS (SELECT 'real' AS series, token, day, close FROM a UNION ALL SELECT 'null', x.token, x.day, y.close FROM a x JOIN a y ON y.pool = x.pool AND y.token = x.token AND y.h = x.k),
co AS (SELECT token, avg(c) AS cost FROM (SELECT token, {_COST} AS c, row_number() OVER (PARTITION BY token ORDER BY reserve_usd DESC, pool) AS r FROM (SELECT DISTINCT token, pool FROM g) p JOIN meta ON meta.pair_address = p.pool) WHERE r <= 2 GROUP BY 1),
d AS (SELECT series, token, day, round((max(close) - min(close)) / median(close), 9) AS x FROM s GROUP BY 1, 2, 3), p AS (SELECT *, lag(x) OVER (PARTITION BY series, token ORDER BY day) AS before FROM d)
SELECT series, token, count(*) AS n, round(max(cost), 6) AS cost, round(median(x), 6) AS median_x, round(avg(CASE WHEN x > cost THEN 1.0 ELSE 0 END), 6) AS above, count(*) FILTER (WHERE before > cost) AS events, round(coalesce(sum(least(before, x) - cost) FILTER (WHERE before > cost), 0), 4) AS net_sum, round(coalesce(avg(CASE WHEN least(before, x) > cost THEN 1.0 ELSE 0 END) FILTER (WHERE before > cost), 0), 6) AS net_positive FROM p JOIN co USING (token) GROUP BY 1, 2""")
def _(t):
    """Dispersion of a token's pools on days on which all have a bar: what is still open a day after it passed the cost of a round trip over the two largest pools; and the same with each pool's days shuffled."""
    g = materialised(t.sql(_GROUP))
    pools = g.groupBy("token").agg(F.count_distinct("pool").alias("np")).where("np >= 2")
    days = g.join(pools, "token").groupBy("token", "day", "np").agg(F.count("*").alias("c")).where("c = np").select("token", "day")
    a = g.join(days, ["token", "day"])
    null = _shuffled_days(a)
    s = a.select(F.lit("real").alias("series"), "token", "day", "close").unionByName(null.select(F.lit("null").alias("series"), "token", "day", "close"))
    m = t.meta.select(F.col(P).alias("pool"), "chain", "reserve_usd")
    c = g.select("token", "pool").distinct().join(m, "pool").withColumn("c", C.study_cost(F.col("chain"), F.col("reserve_usd")))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("reserve_usd"), "pool"))).where("r <= 2").groupBy("token").agg(F.avg("c").alias("cost"))
    d = s.groupBy("series", "token", "day").agg(F.round((F.max("close") - F.min("close")) / F.median("close"), 9).alias("x"))  # the pools of a token on a day
    p = materialised(d.withColumn("before", F.lag("x").over(Window.partitionBy("series", "token").orderBy("day"))).join(c, "token"))
    hit, open_ = F.col("before") > F.col("cost"), F.least("before", "x")
    out = p.groupBy("series", "token").agg(
        F.count("*").alias("n"),
        F.round(F.max("cost"), 6).alias("cost"),
        F.round(F.avg((F.col("x") > F.col("cost")).cast("double")), 6).alias("above"),
        F.count_if(hit).alias("events"),
        F.round(F.coalesce(F.sum(F.when(hit, open_ - F.col("cost"))), F.lit(0.0)), 4).alias("net_sum"),
        F.round(F.coalesce(F.avg(F.when(hit, (open_ > F.col("cost")).cast("double"))), F.lit(0.0)), 6).alias("net_positive"),
    )
    return out.join(quantiles(p, ["series", "token"], "x", {"median_x": 0.5}), ["series", "token"]).withColumn("median_x", F.round("median_x", 6))


def _shuffled_days(a):
    key = F.md5(F.concat_ws("|", F.lit("arb"), "pool", F.col("day").cast("string")).cast("binary"))
    w = Window.partitionBy("token", "pool")
    x = a.withColumns({"k": F.row_number().over(w.orderBy("day")), "h": F.row_number().over(w.orderBy(key, "day"))})
    return x.select("token", "pool", "day", "k").join(x.select("token", "pool", F.col("h").alias("k"), "close"), ["token", "pool", "k"])


# Selection --------------------------------------------------------------------------------------------------------------------
_SPLITS = (0.5, 0.6, 0.7)


@query("split_sweep", f"""WITH {_PANEL}, x AS (SELECT d, fwd, count(*) OVER w AS n, median(fwd) OVER w AS bench, quantile_cont(fwd, 0.95) OVER w AS cap, row_number() OVER (PARTITION BY d ORDER BY mom DESC, pair_address) AS hi, row_number() OVER (PARTITION BY d ORDER BY mom, pair_address) AS lo FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL AND d % 7 = 0 WINDOW w AS (PARTITION BY d)),
ks(k) AS (VALUES (1), (2), (3)), rec AS (SELECT k, direction, d, avg(least(fwd, cap)) - max(bench) AS edge FROM (SELECT *, 'high' AS direction, hi AS r FROM x UNION ALL SELECT *, 'low', lo FROM x) y, ks WHERE r <= k AND n >= 3 * k GROUP BY 1, 2, 3),
e AS (SELECT min(d) AS a, max(d) AS z FROM x), sp(split) AS (VALUES (0.5), (0.6), (0.7))
SELECT CAST(split AS DOUBLE) AS split, k, direction, count(*) AS days, round(avg(edge) FILTER (WHERE d < a + split * (z - a)), 6) AS is_edge, round(avg(edge) FILTER (WHERE d >= a + split * (z - a)), 6) AS oos_edge FROM rec, e, sp GROUP BY 1, 2, 3""")
def _(t):
    """Edge of the top picks by past return (both ways, winsorised) over the day's median, before and after a split of the calendar at three places."""
    x = panel(t).where("mom is not null and fwd is not null and d % 7 = 0")
    w = Window.partitionBy("d")  # the names of a day
    x = x.withColumns({"n": F.count("*").over(w), "bench": F.percentile("fwd", 0.5).over(w), "cap": F.percentile("fwd", 0.95).over(w), "high": F.row_number().over(w.orderBy(F.desc("mom"), P)), "low": F.row_number().over(w.orderBy(F.asc("mom"), P))})
    x = x.select("d", "fwd", "n", "bench", "cap", F.expr("stack(2, 'high', high, 'low', low) as (direction, r)")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rec = x.where("r <= k and n >= 3 * k").groupBy("k", "direction", "d").agg((F.avg(F.least("fwd", "cap")) - F.max("bench")).alias("edge"))
    ends = panel(t).where("mom is not null and fwd is not null and d % 7 = 0").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    s = rec.join(F.broadcast(ends)).withColumn("split", F.explode(F.array(*[F.lit(v) for v in _SPLITS])))  # one row
    early = F.col("d") < F.col("a") + F.col("split") * (F.col("z") - F.col("a"))
    return rounded(s.groupBy("split", "k", "direction").agg(F.count("*").alias("days"), F.avg(F.when(early, F.col("edge"))).alias("is_edge"), F.avg(F.when(~early, F.col("edge"))).alias("oos_edge")))


_USED = ("ret5", "vol20", "turnover", "rng")


@query("composite_rank", f"""WITH {_IB}, {_F13}, f AS (SELECT pair_address, i, {', '.join(f'{_lag(c)} AS {c}' for c in _USED)} FROM b), y AS (SELECT f.*, ib.day, {_lag('ib.close', -7).replace('BY pair_address', 'BY f.pair_address').replace('BY i', 'BY f.i')} / ib.close - 1 AS fwd FROM f JOIN ib ON ib.pair_address = f.pair_address AND ib.i = f.i),
u AS (SELECT * FROM y WHERE fwd IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _USED)} AND i % 7 = 0), sp AS (SELECT min(day) + CAST(floor(0.6 * (max(day) - min(day))) AS INTEGER) AS cut FROM u),
l AS MATERIALIZED (SELECT pair_address, day, fwd, day < cut AS early, avg(fwd) OVER (PARTITION BY day) AS bench, count(*) OVER (PARTITION BY day, feature) AS n, feature, v, coalesce((v - avg(v) OVER (PARTITION BY day, feature)) / nullif(round(stddev_samp(v) OVER (PARTITION BY day, feature), 12), 0), 0) AS z FROM (SELECT pair_address, day, fwd, cut, unnest([{', '.join(f"'{c}'" for c in _USED)}]) AS feature, unnest([{', '.join(_USED)}]) AS v FROM u, sp)),
r AS (SELECT *, row_number() OVER (PARTITION BY day, feature ORDER BY v DESC, pair_address) AS hi, row_number() OVER (PARTITION BY day, feature ORDER BY v, pair_address) AS lo FROM l),
e AS (SELECT feature, round(avg(fwd - bench) FILTER (WHERE hi <= 2), 9) AS high, round(avg(fwd - bench) FILTER (WHERE lo <= 2), 9) AS low FROM r WHERE early AND n >= 6 GROUP BY 1), ch AS (SELECT feature, CASE WHEN low > high THEN -1 ELSE 1 END AS sign, greatest(high, low) AS edge FROM e WHERE greatest(high, low) > 0),
k AS (SELECT pair_address, day, any_value(early) AS early, any_value(fwd) AS fwd, any_value(bench) AS bench, any_value(n) AS n, round(sum(sign * z), 9) AS score FROM l JOIN ch USING (feature) GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, pair_address) AS rk FROM k)
SELECT feature, CASE WHEN sign > 0 THEN 'high' ELSE 'low' END AS direction, round(edge, 6) AS is_edge, NULL::DOUBLE AS oos_edge FROM ch UNION ALL SELECT 'composite', 'high', round(avg(fwd - bench) FILTER (WHERE early), 6), round(avg(fwd - bench) FILTER (WHERE NOT early), 6) FROM q WHERE rk <= 2 AND n >= 6 HAVING count(*) > 0""")
def _(t):
    """Features whose better direction has an edge in the first 60 % of the calendar, their z scores of the day added up with that sign, and the edge of the top picks by the sum in sample and after."""
    u = features(t).withColumn("fwd", F.lead("close", 7).over(R.w()) / F.col("close") - 1).where("i % 7 = 0").dropna(subset=[*_USED, "fwd"])
    u = materialised(u.select(P, "day", "fwd", *_USED))
    cut = u.agg(F.expr("date_add(min(day), cast(floor(0.6 * datediff(max(day), min(day))) as int))").alias("cut"))
    day, one = Window.partitionBy("day"), Window.partitionBy("day", "feature")  # the names of a day
    x = u.join(F.broadcast(cut)).withColumns({"early": F.col("day") < F.col("cut"), "bench": F.avg("fwd").over(day), "n": F.count("*").over(day)})  # one row
    x = x.select(P, "day", "fwd", "early", "bench", "n", F.expr(f"stack({len(_USED)}, {', '.join(f'{c!r}, {c}' for c in _USED)}) as (feature, v)"))
    sd = F.round(F.stddev_samp("v").over(one), 12)
    x = x.withColumns({"z": F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(one), F.when(sd > 0, sd)), F.lit(0.0)), "hi": F.row_number().over(one.orderBy(F.desc("v"), P)), "lo": F.row_number().over(one.orderBy(F.asc("v"), P))})
    x = materialised(x)
    edge = F.col("fwd") - F.col("bench")
    e = x.where("early and n >= 6").groupBy("feature").agg(F.round(F.avg(F.when(F.col("hi") <= 2, edge)), 9).alias("high"), F.round(F.avg(F.when(F.col("lo") <= 2, edge)), 9).alias("low"))
    chosen = e.where("greatest(high, low) > 0").select("feature", F.when(F.col("low") > F.col("high"), -1).otherwise(1).alias("sign"), F.greatest("high", "low").alias("is_edge"))
    k = x.join(F.broadcast(chosen), "feature").groupBy(P, "day").agg(F.first("early").alias("early"), F.first("fwd").alias("fwd"), F.first("bench").alias("bench"), F.first("n").alias("n"), F.round(F.sum(F.col("sign") * F.col("z")), 9).alias("score"))  # a row a feature
    q = k.withColumn("rk", F.row_number().over(day.orderBy(F.desc("score"), P))).where("rk <= 2 and n >= 6")
    whole = q.agg(F.count("*").alias("c"), F.avg(F.when(F.col("early"), edge)).alias("is_edge"), F.avg(F.when(~F.col("early"), edge)).alias("oos_edge")).where("c > 0")
    parts = chosen.select("feature", F.when(F.col("sign") > 0, "high").otherwise("low").alias("direction"), "is_edge", F.lit(None).cast("double").alias("oos_edge"))
    return rounded(parts.unionByName(whole.select(F.lit("composite").alias("feature"), F.lit("high").alias("direction"), "is_edge", "oos_edge")))


# Objectives and regimes over real trades --------------------------------------------------------------------------------------
_DRAWS = [(0.15, 0.1, 10), (0.3, 0.2, 20), (0.05, 0.05, 5)]
_PF = "CASE WHEN sum(least(ret - 0.01, 0)) < 0 THEN sum(greatest(ret - 0.01, 0)) / -sum(least(ret - 0.01, 0)) WHEN sum(greatest(ret - 0.01, 0)) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"
_TAPE = " UNION ALL ".join(f"SELECT {d} AS draw, * FROM ({_sim_sql('roc_rev', *p, extra='SELECT pair_address, CAST(ret AS DOUBLE) AS ret FROM t')})" for d, p in enumerate(_DRAWS))


@query("objective_scores", f"""WITH {_IB}, tape AS ({_TAPE}), s AS (SELECT pair_address, draw, count(*) AS n, {_PF} AS pf, avg(ret - 0.01) AS netpt FROM tape GROUP BY 1, 2 HAVING count(*) >= 5),
o AS (SELECT pair_address, draw, n, unnest(['pf', 'pf_pen', 'netpt']) AS objective, unnest([pf, 1 + n / (n + 10.0) * (least(pf, 10) - 1), netpt]) AS score FROM s)
SELECT pair_address, objective, draw, n, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY pair_address, objective ORDER BY round(score, 9) DESC, draw) = 1""")
def _(t):
    """Of three brackets the one that each objective picks for a pair: profit factor, profit factor drawn to 1 for few trades, net by trade."""
    b, tape = materialised(R.signal(ib(t), "roc_rev").select(P, "i", "entry", "high", "low", "close")), None
    for d, p in enumerate(_DRAWS):
        one = R.simulate(b, *p).select(F.lit(d).alias("draw"), P, "ret")
        tape = one if tape is None else tape.unionByName(one)
    s = R.score(tape, [P, "draw"], 0.01).where("n >= 5").withColumn("pf_pen", R.penalised(F.col("pf"), F.col("n")))
    o = s.select(P, "draw", "n", F.expr("stack(3, 'pf', pf, 'pf_pen', pf_pen, 'netpt', avg_trade) as (objective, score)"))
    best = o.withColumn("r", F.row_number().over(Window.partitionBy(P, "objective").orderBy(F.desc(F.round("score", 9)), "draw"))).where("r = 1")
    return rounded(best.select(P, "objective", "draw", "n", "score"))


_VARIANTS = {"UNCOND": "true", "RISK_ON_TREND": "up", "RISK_OFF_TREND": "NOT up", "RISK_ON_LOWVOL": "calm", "RISK_OFF_LOWVOL": "NOT calm", "MASTER_ON": "up AND calm", "MASTER_OFF": "NOT (up AND calm)"}


def _masked(mask):
    sql = _sim_sql("roc_rev", 0.15, 0.1, 10, extra="SELECT pair_address, CAST(ret AS DOUBLE) AS ret FROM t")
    return sql.replace("SELECT pair_address, i, entry, close, low, high, count(*)", f"SELECT pair_address, i, entry AND ({mask}) AS entry, close, low, high, count(*)", 1).replace("AS n FROM sig)", "AS n FROM sig JOIN h USING (day))", 1)


@query("regime_trades", f"WITH {_IB}, {_MKT}, tape AS ({' UNION ALL '.join(f'''SELECT '{k}' AS variant, * FROM ({_masked(m)})''' for k, m in _VARIANTS.items())}) SELECT variant, count(*) AS n, count(DISTINCT pair_address) AS pairs, round(sum(ret - 0.01), 6) AS net, round(avg(ret - 0.01), 6) AS avg_trade, round({_PF}, 6) AS pf FROM tape GROUP BY 1")
def _(t):
    """One-at-a-time trades of a signal that may enter only on days of a regime of the market, for seven regimes."""
    b = R.signal(ib(t), "roc_rev").select(P, "i", "day", "entry", "high", "low", "close").join(F.broadcast(regimes(t)), "day")  # a row a day
    b, tape = materialised(b), None
    for name, mask in _VARIANTS.items():
        one = R.simulate(b.withColumn("entry", F.col("entry") & F.expr(mask)), 0.15, 0.1, 10).select(F.lit(name).alias("variant"), P, "ret")
        tape = one if tape is None else tape.unionByName(one)
    tape = materialised(tape)
    pairs = tape.groupBy("variant").agg(F.count_distinct(P).alias("pairs"))
    return rounded(R.score(tape, ["variant"], 0.01).join(pairs, "variant").select("variant", "n", "pairs", "net", "avg_trade", "pf"))


# Nulls and samples ------------------------------------------------------------------------------------------------------------
@query("momentum_and_null", f"""WITH {_IB}, s AS (SELECT pair_address, i, close, row_number() OVER (PARTITION BY pair_address ORDER BY md5(concat_ws('|', 'null', pair_address, CAST(i AS STRING))), i) - 1 AS k FROM ib),
v AS (SELECT 'real' AS series, pair_address, i, close FROM s UNION ALL SELECT 'null', a.pair_address, a.i, b.close FROM s a JOIN s b ON b.pair_address = a.pair_address AND b.k = a.i),
r AS (SELECT *, close / lag(close) OVER w - 1 AS r, lead(close) OVER w / close - 1 AS nxt FROM v WINDOW w AS (PARTITION BY series, pair_address ORDER BY i)), g AS (SELECT series, pair_address, count(*) AS n, avg(nxt) AS m FROM r WHERE r > 0 AND nxt IS NOT NULL GROUP BY 1, 2)
SELECT pair_address, a.n AS n_real, b.n AS n_null, round(a.m, 6) AS real, round(b.m, 6) AS "null", round(a.m - b.m, 6) + 0.0 AS gap FROM (SELECT * FROM g WHERE series = 'real') a JOIN (SELECT * FROM g WHERE series = 'null') b USING (pair_address)""")
def _(t):
    """The next bar's mean return after a rise, side by side for the bars and for the same bars in a shuffled order."""
    b = materialised(R.numbered(t.bars).select(P, "i", "close"))
    null = R.shuffled(b, "null", [P], ["close"]).select(P, "i", "close")
    v = b.withColumn("series", F.lit("real")).unionByName(null.withColumn("series", F.lit("null")))
    w = Window.partitionBy("series", P).orderBy("i")
    r = v.withColumns({"r": F.col("close") / F.lag("close").over(w) - 1, "nxt": F.lead("close").over(w) / F.col("close") - 1}).where("r > 0 and nxt is not null")
    g = r.groupBy(P).pivot("series", ["real", "null"]).agg(F.count("nxt").alias("n"), F.avg("nxt").alias("m"))
    g = g.where("real_n > 0 and null_n > 0")
    return rounded(g.select(P, F.col("real_n").alias("n_real"), F.col("null_n").alias("n_null"), F.col("real_m").alias("real"), F.col("null_m").alias("null"), (F.col("real_m") - F.col("null_m")).alias("gap"))).withColumn("gap", F.col("gap") + F.lit(0.0))


SAMPLE, RECENT = 20, 500


@query("sampled_revert_fees", f"""WITH x AS (SELECT user_id AS pool, event_id, event_type = 'error' AS bad, value * 5000 AS fee, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), l AS (SELECT * FROM x WHERE r <= {RECENT}),
f AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY r) AS k FROM l WHERE bad), a AS (SELECT pool, count(*) AS sampled, avg(fee) AS mean FROM f WHERE k <= {SAMPLE} GROUP BY 1)
SELECT pool, count(*) AS total, count(*) FILTER (WHERE bad) AS reverts, round(count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE), 6) AS rate, coalesce(max(sampled), 0) AS sampled, round(coalesce(max(mean), 0) * count(*) FILTER (WHERE bad) / 1e9, 9) AS lost_native FROM l LEFT JOIN a USING (pool) GROUP BY 1""")
def _(t):
    """Of each pool's last 500 transactions the share that failed, and the gas lost: the mean fee of the first failed ones, times their number."""
    w = Window.partitionBy("pool")
    x = t.events.select(F.col("user_id").alias("pool"), "event_id", "ts", (F.col("event_type") == "error").alias("bad"), (F.col("value") * 5000).alias("fee"))
    x = x.withColumn("r", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("r") <= RECENT)
    x = x.withColumn("k", F.sum(F.col("bad").cast("int")).over(w.orderBy("r")))
    taken = F.col("bad") & (F.col("k") <= SAMPLE)
    n, bad = F.count("*"), F.count_if("bad")
    lost = F.coalesce(F.avg(F.when(taken, F.col("fee"))), F.lit(0.0)) * bad / 1e9
    return x.groupBy("pool").agg(n.alias("total"), bad.alias("reverts"), F.round(bad / n, 6).alias("rate"), F.count_if(taken).alias("sampled"), F.round(lost, 9).alias("lost_native"))


# Combinations -----------------------------------------------------------------------------------------------------------------
def _setting_sql(a, n, t):
    if a == "momentum":
        return f"c1 / {_lag('c1', n)} - 1 > {t}"
    if a == "breakout":
        return f"c1 >= {_n('max', 'c1', n)}"
    if a == "reversion":
        return f"(c1 - {_n('avg', 'c1', n)}) / nullif({_n('stddev_samp', 'c1', n)}, 0) < -{t}"
    return f"v1 > {t} * {_n('avg', 'v1', n)} AND c1 / {_lag('c1')} - 1 > 0"


_ENDS = ", ".join(f"coalesce(min(b.i) FILTER (WHERE b.i <= a.i + {hold} AND b.close <= a.close * {1 - stop!r}), least(a.i + {hold}, a.n - 1)) AS z{k}" for k, (hold, stop) in enumerate(O.BRACKETS))
_CORPUS = f"""{_IB}, q AS (SELECT min(day) AS lo, max(day) AS hi FROM bars), sg AS MATERIALIZED (SELECT pair_address, i, day, close, count(*) OVER (PARTITION BY pair_address) AS n, day - lo < 0.6 * (hi - lo) AS part, [{', '.join(f'coalesce({_setting_sql(*x)}, false)' for x in O.SETTINGS)}] AS sigs FROM (SELECT *, {_lag('close')} AS c1, {_lag('coalesce(volume, 0)')} AS v1 FROM ib), q),
ex AS MATERIALIZED (SELECT a.pair_address, a.i, {_ENDS} FROM sg a JOIN sg b ON b.pair_address = a.pair_address AND b.i > a.i AND b.i <= a.i + 14 WHERE a.i < a.n - 1 GROUP BY a.pair_address, a.i, a.n),
en AS (SELECT pair_address, i, unnest(range(0, {len(O.BRACKETS)})) AS k, unnest([{', '.join(f'z{k}' for k in range(len(O.BRACKETS)))}]) AS z FROM ex),
er AS MATERIALIZED (SELECT en.*, y.close / x.close - 1 AS ret, x.part FROM en JOIN sg x ON x.pair_address = en.pair_address AND x.i = en.i JOIN sg y ON y.pair_address = en.pair_address AND y.i = en.z),
co AS (SELECT pair_address, {_COST} AS cost FROM meta), cb(combo, g, k) AS (VALUES {', '.join(f"('{n}', {g}, {k})" for n, g, k in O.names())}),
on_ AS (SELECT pair_address, i, unnest(range(0, {len(O.SETTINGS)})) AS g, unnest(sigs) AS hit FROM sg),
ca AS (SELECT combo, on_.pair_address, part, list({{'i': CAST(er.i AS BIGINT), 'free': CAST(z + 1 AS BIGINT), 'n': 0::BIGINT, 'g': 0::DOUBLE, 'l': 0::DOUBLE, 'net': ret - cost}} ORDER BY er.i) AS c FROM on_ JOIN cb ON cb.g = on_.g AND hit JOIN er ON er.pair_address = on_.pair_address AND er.i = on_.i AND er.k = cb.k JOIN co ON co.pair_address = on_.pair_address GROUP BY 1, 2, 3),
fo AS MATERIALIZED (SELECT combo, pair_address, part, list_reduce(c, lambda a, x: CASE WHEN x.i >= a.free THEN {{'i': x.i, 'free': x.free, 'n': a.n + 1, 'g': a.g + greatest(x.net, 0), 'l': a.l + least(x.net, 0), 'net': a.net + x.net}} ELSE a END, {{'i': -1::BIGINT, 'free': -1::BIGINT, 'n': 0::BIGINT, 'g': 0::DOUBLE, 'l': 0::DOUBLE, 'net': 0::DOUBLE}}) AS r FROM ca)"""


def _pf_of(part):
    g, l = f"coalesce(sum(r.g) FILTER (WHERE {part}), 0)", f"coalesce(sum(r.l) FILTER (WHERE {part}), 0)"  # noqa: E741
    return f"CASE WHEN {l} < 0 THEN {g} / -{l} WHEN {g} > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"


_SIDES = f"CAST(coalesce(sum(r.n) FILTER (WHERE part), 0) AS BIGINT) AS is_n, CAST(coalesce(sum(r.n) FILTER (WHERE NOT part), 0) AS BIGINT) AS oos_n, round({_pf_of('part')}, 6) AS is_pf, round({_pf_of('NOT part')}, 6) AS oos_pf, round(coalesce(sum(r.net) FILTER (WHERE NOT part), 0), 6) AS oos_net"


def combo_trades(t):
    """The trades of 204 combinations, and each pair's cost of a round trip."""
    edge = F.broadcast(t.bars.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))  # one row
    b = R.numbered(t.bars).join(edge).withColumn("part", F.datediff("day", "lo") < 0.6 * F.datediff("hi", "lo"))
    cost = t.meta.select(P, C.study_cost(F.col("chain"), F.col("reserve_usd")).alias("cost"))
    return O.trades(O.with_settings(b.select(P, "i", "close", "volume", "part"))), cost


@query("combo_pooled", f"WITH {_CORPUS} SELECT combo, {_SIDES}, round({_pf_of('part')}, 6) > 1 AND coalesce(sum(r.n) FILTER (WHERE part), 0) >= 20 AS chosen FROM fo GROUP BY combo")
def _(t):
    """Every combination of the grid pooled over all pairs: before and after 60 % of the calendar, chosen if it made money before."""
    tape, cost = combo_trades(t)
    out = rounded(O.scored(tape, ["combo"], cost))
    return out.withColumn("chosen", (F.col("is_pf") > 1) & (F.col("is_n") >= 20))


@query("combo_corpus", f"WITH {_CORPUS}, s AS (SELECT combo, pair_address, {_SIDES} FROM fo GROUP BY 1, 2) SELECT * FROM s WHERE is_n >= 5 AND is_pf > 1 AND oos_n > 0")
def _(t):
    """Strategies of a combination and a pair that made money in sample, with what they made after."""
    tape, cost = combo_trades(t)
    return rounded(O.scored(tape, ["combo", P], cost)).where("is_n >= 5 and is_pf > 1 and oos_n > 0")


# Launches: earlier coins choose for later ones --------------------------------------------------------------------------------
#: Entry ages, targets, stops, holdings.
_POINTS = [(t, tp, sl, mh) for t in (0, 1, 2, 3, 5, 7, 10) for tp in (0.15, 0.3, 0.5, 1.0) for sl in (0.1, 0.2, 0.3) for mh in (5, 10, 20, 40)]
_LAST_BAR = max(t + mh for t, _, _, mh in _POINTS)
FOLDS = 4


def launch_trades(t):
    """g (grid point), pair, net of the one trade of every pair at every point: entered at an age, out at the stop, the target or the holding's end."""
    b = R.numbered(t.bars).select(P, "i", "high", "low", "close")
    n = b.groupBy(P).agg(F.count("*").alias("n"))
    a = b.where(F.col("i") <= _LAST_BAR).groupBy(P).agg(F.array_sort(F.collect_list(F.struct("i", "high", "low", "close"))).alias("s")).join(n, P)  # some 50 bars of a pair
    points = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(age).alias("t"), F.lit(tp).alias("tp"), F.lit(sl).alias("sl"), F.lit(mh).alias("mh")) for g, (age, tp, sl, mh) in enumerate(_POINTS)])
    x = a.withColumn("point", F.explode(points)).select(P, "s", "n", "point.*").where("t < n - 1 and s[t].close > 0").withColumn("e", F.expr("cast(least(t + mh, n - 1) as int)"))
    x = x.withColumn("hit", F.expr("array_min(filter(sequence(t + 1, e), j -> s[j].low <= s[t].close * (1 - sl) or s[j].high >= s[t].close * (1 + tp)))"))
    ret = F.expr("if(hit is null, s[e].close / s[t].close - 1, if(s[hit].low <= s[t].close * (1 - sl), -sl, tp))")
    cost = t.meta.select(P, C.study_cost(F.col("chain"), F.col("reserve_usd")).alias("cost"))
    return x.select("g", P, ret.alias("ret")).join(cost, P).select("g", P, (F.col("ret") - F.col("cost")).alias("net"))


@query("launch_grid_walk_forward", f"""WITH {_IB}, pt(g, t, tp, sl, mh) AS (VALUES {', '.join(f'({g}, {a}, {b}::DOUBLE, {c}::DOUBLE, {d})' for g, (a, b, c, d) in enumerate(_POINTS))}), nn AS (SELECT pair_address, count(*) AS n FROM ib GROUP BY 1),
h AS (SELECT e.pair_address, g, tp, sl, e.close AS ep, least(t + mh, nn.n - 1) AS fin, min(b.i) FILTER (WHERE b.low <= e.close * (1 - sl) OR b.high >= e.close * (1 + tp)) AS hit FROM ib e JOIN nn USING (pair_address) JOIN pt ON pt.t = e.i JOIN ib b ON b.pair_address = e.pair_address AND b.i > t AND b.i <= least(t + mh, nn.n - 1) WHERE t < nn.n - 1 AND e.close > 0 GROUP BY ALL),
tr AS MATERIALIZED (SELECT h.pair_address, g, CASE WHEN hit IS NULL THEN z.close / ep - 1 WHEN z.low <= ep * (1 - sl) THEN -sl ELSE tp END - {_COST} AS net FROM h JOIN ib z ON z.pair_address = h.pair_address AND z.i = coalesce(hit, fin) JOIN meta ON meta.pair_address = h.pair_address),
fd AS (SELECT pair_address, a, h, least((a - 1) // (m // 4), 3) AS fold, m // 4 AS size FROM (SELECT pair_address, row_number() OVER (ORDER BY pair_address) AS a, row_number() OVER (ORDER BY md5(concat_ws('|', 'launch', pair_address)), pair_address) AS h, count(*) OVER () AS m FROM nn) WHERE m >= 4),
sm AS (SELECT fold, g, sum(greatest(net, 0)) AS gain, sum(least(net, 0)) AS loss, count(*) AS n, max(size) AS size FROM tr JOIN fd USING (pair_address) GROUP BY 1, 2), ts(test) AS (VALUES (1), (2), (3)),
sc AS (SELECT test, g, round(CASE WHEN sum(loss) < 0 THEN sum(gain) / -sum(loss) WHEN sum(gain) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 9) AS pf FROM sm JOIN ts ON fold < test GROUP BY 1, 2 HAVING sum(n) >= 10 AND test * max(size) >= 10),
ch AS (SELECT test, g FROM sc QUALIFY row_number() OVER (PARTITION BY test ORDER BY pf DESC, g) = 1),
oo AS (SELECT 'real' AS series, test, ch.g, net FROM ch JOIN fd ON fold = test JOIN tr ON tr.g = ch.g AND tr.pair_address = fd.pair_address UNION ALL SELECT 'null', test, ch.g, net FROM ch JOIN fd ON fold = test JOIN fd o ON o.h = fd.a JOIN tr ON tr.g = ch.g AND tr.pair_address = o.pair_address)
SELECT series, CAST(test AS BIGINT) AS fold, CAST(t AS INTEGER) AS age, tp, sl, CAST(mh AS INTEGER) AS hold, count(*) AS n, round(sum(net), 6) AS net, round(avg(net), 6) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win FROM oo JOIN pt USING (g) GROUP BY ALL""")
def _(t):
    """Of 336 ways to trade a launch the one that did best on the coins of earlier folds (by profit factor) is traded on the next fold, and, as a null, on other coins than the fold's."""
    tape = materialised(launch_trades(t))
    pairs = t.bars.select(P).distinct()
    size = pairs.agg(F.floor(F.count("*") / FOLDS).alias("size")).where("size > 0")
    a = running(pairs, [], [P], {"a": F.lit(1)})
    h = running(pairs.withColumn("_h", hash_order("launch", F.col(P))), [], ["_h", P], {"h": F.lit(1)}).drop("_h")
    f = materialised(a.join(h, P).join(F.broadcast(size)).withColumn("fold", F.least(F.floor((F.col("a") - 1) / F.col("size")), F.lit(FOLDS - 1))))  # one row
    sums = tape.join(f, P).groupBy("fold", "g").agg(F.sum(F.greatest("net", F.lit(0.0))).alias("gain"), F.sum(F.least("net", F.lit(0.0))).alias("loss"), F.count("*").alias("n"), F.max("size").alias("size"))
    tests = sums.withColumn("test", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, FOLDS)]))).where("fold < test")
    scores = tests.groupBy("test", "g").agg(F.round(C.profit_factor(F.sum("gain"), F.sum("loss")), 9).alias("pf"), F.sum("n").alias("n"), F.max("size").alias("size")).where("n >= 10 and test * size >= 10")
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("test").orderBy(F.desc("pf"), "g"))).where("r = 1").select(F.col("test").alias("fold"), "g")  # a row a fold
    own = f.join(F.broadcast(best), "fold").select("fold", "g", "a", P)
    real = own.join(tape, ["g", P]).select(F.lit("real").alias("series"), "fold", "g", "net")
    others = f.select(F.col("h").alias("a"), F.col(P).alias("_other"))
    null = own.drop(P).join(others, "a").withColumnRenamed("_other", P).join(tape, ["g", P]).select(F.lit("null").alias("series"), "fold", "g", "net")
    table = t.spark.createDataFrame([(g, *x) for g, x in enumerate(_POINTS)], "g int, age int, tp double, sl double, hold int")
    o = real.unionByName(null).groupBy("series", "fold", "g").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win"))
    return rounded(o.join(F.broadcast(table), "g").select("series", "fold", "age", "tp", "sl", "hold", "n", "net", "mean", "win"))  # 336 rows
