"""Queries over price bars: indicators, signals, simulations, nulls, selection, portfolios, liquidity providing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.functions.rolling import average_rank, correlation, ema, hash_order, ordered_sum, rolling
from ammlytics.operators import research as R
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.session import materialised

P = "pair_address"
# ib: numbered bars with what the families need
_IB = """ib AS (SELECT *, close - coalesce(p0, close) AS chg, coalesce(p0, pl) AS prev, greatest(high - low, abs(high - coalesce(p0, close)), abs(low - coalesce(p0, close))) AS tr
 FROM (SELECT *, lag(close) OVER w AS p0, last_value(close) OVER (PARTITION BY pair_address ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pl, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY pair_address ORDER BY day)))"""


def _n(agg, x, n, least=None):
    return f"(CASE WHEN count({x}) OVER (PARTITION BY pair_address ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {least or n} THEN {agg}({x}) OVER (PARTITION BY pair_address ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END)"


def _lag(x, n=1):
    return f"lag({x}, {n}) OVER (PARTITION BY pair_address ORDER BY i)"


_RSI = f"CASE WHEN {_n('avg', 'greatest(-chg, 0)', 14)} > 0 THEN 100 - 100 / (1 + {_n('avg', 'greatest(chg, 0)', 14)} / {_n('avg', 'greatest(-chg, 0)', 14)}) END"
_RAW = {
    "sma_cross": f"{_n('avg', 'close', 5)} > {_n('avg', 'close', 20)}",
    "price_above_ma": f"close > {_n('avg', 'close', 20)}",
    "donchian_bo": f"close >= {_n('max', 'high', 20)}",
    "donchian_rev": f"close <= {_n('min', 'low', 20)}",
    "rsi_os": f"({_RSI}) < 30",
    "rsi_mom": f"({_RSI}) > 60",
    "boll_rev": f"close < {_n('avg', 'close', 20)} - 1.5 * {_n('stddev_samp', 'close', 20)}",
    "boll_bo": f"close > {_n('avg', 'close', 20)} + 1.5 * {_n('stddev_samp', 'close', 20)}",
    "atr_bo": f"close > prev + {_n('avg', 'tr', 14)}",
    "roc_mom": f"close / {_lag('close', 5)} - 1 > 0.1",
    "roc_rev": f"close / {_lag('close', 5)} - 1 < -0.1",
    "vol_bo": f"volume > 2 * {_n('avg', 'volume', 20)} AND close > prev",
    "consec_down": _n("sum", "CASE WHEN chg < 0 THEN 1 ELSE 0 END", 3) + " >= 3",
    "consec_up": _n("sum", "CASE WHEN chg > 0 THEN 1 ELSE 0 END", 3) + " >= 3",
}
_SHIFT = "coalesce(lag(raw) OVER (PARTITION BY pair_address ORDER BY i), false)"


def _entries(family):
    return f"sig AS (SELECT *, {_SHIFT} AS entry FROM (SELECT *, {_RAW[family]} AS raw FROM ib))"


def ib(t):
    return R.base_columns(R.numbered(t.bars))


for _f in _RAW:
    query(f"signal_{_f}", f"WITH {_IB}, {_entries(_f)} SELECT pair_address, i, entry FROM sig WHERE entry")(lambda t, f=_f: R.signal(ib(t), f).where("entry").select(P, "i", "entry"))

_EMA = """e{n} AS (SELECT pair_address, i, close AS e FROM ib WHERE i = 0 UNION ALL SELECT b.pair_address, b.i, 2.0 / ({n} + 1) * b.close + (1 - 2.0 / ({n} + 1)) * e{n}.e FROM e{n} JOIN ib b ON b.pair_address = e{n}.pair_address AND b.i = e{n}.i + 1)"""


@query("signal_ema_cross", f"WITH RECURSIVE {_IB}, {_EMA.format(n=5)}, {_EMA.format(n=21)}, x AS (SELECT pair_address, i, e5.e > e21.e AS raw FROM e5 JOIN e21 USING (pair_address, i)) SELECT pair_address, i, entry FROM (SELECT *, {_SHIFT} AS entry FROM x) WHERE entry")
def _(t):
    return R.signal(ib(t), "ema_cross").where("entry").select(P, "i", "entry")


@query("signal_ma_pullback", f"WITH {_IB}, m AS (SELECT *, {_n('avg', 'close', 20)} AS ma FROM ib), x AS (SELECT *, ma > {_lag('ma', 3)} AND close < ma AND close > prev AS raw FROM m) SELECT pair_address, i, entry FROM (SELECT *, {_SHIFT} AS entry FROM x) WHERE entry")
def _(t):
    return R.signal(ib(t), "ma_pullback").where("entry").select(P, "i", "entry")


@query("indicators", f"WITH {_IB} SELECT pair_address, i, round({_n('avg', 'close', 10)}, 6) AS sma, round({_RSI}, 6) AS rsi, round({_n('max', 'high', 20)}, 6) AS hi, round({_n('min', 'low', 20)}, 6) AS lo, round({_n('avg', 'tr', 14)}, 6) AS atr, round({_n('stddev_samp', 'close', 20)}, 6) AS sd, round(close / {_lag('close', 5)} - 1, 6) AS roc, round(ln(close / {_lag('close')}), 6) AS logret, round(max(close) OVER (PARTITION BY pair_address ORDER BY i), 6) AS peak FROM ib")
def _(t):
    b = ib(t)
    return rounded(b.select(P, "i", R.sma("close", 10).alias("sma"), R.rsi(14).alias("rsi"), rolling(F.max, F.col("high"), R.w(), 20).alias("hi"), rolling(F.min, F.col("low"), R.w(), 20).alias("lo"), R.atr(14).alias("atr"), rolling(F.stddev_samp, F.col("close"), R.w(), 20).alias("sd"), R.roc(5).alias("roc"), F.log(F.col("close") / F.lag("close").over(R.w())).alias("logret"), F.max("close").over(R.w()).alias("peak")))


@query("ema", f"WITH RECURSIVE {_IB}, {_EMA.format(n=12)} SELECT pair_address, i, round(e, 6) AS ema FROM e12")
def _(t):
    return rounded(ema(R.numbered(t.bars).select(P, "i", "close"), [P], "i", "close", 12, "ema").select(P, "i", "ema"))


@query("zscore_shifted", f"WITH {_IB}, s AS (SELECT pair_address, i, {_lag('close')} AS x FROM ib) SELECT pair_address, i, round((x - {_n('avg', 'x', 20)}) / nullif({_n('stddev_samp', 'x', 20)}, 0), 6) AS z FROM s")
def _(t):
    s = R.numbered(t.bars).select(P, "i", F.lag("close").over(R.w()).alias("x"))
    return rounded(s.select(P, "i", F.try_divide(F.col("x") - rolling(F.avg, F.col("x"), R.w(), 20), F.nullif(rolling(F.stddev_samp, F.col("x"), R.w(), 20), F.lit(0.0))).alias("z")))


_EQUITY = f"WITH {_IB}, r AS (SELECT pair_address, i, least(greatest(close / {_lag('close')} - 1, -0.9), 1) AS r FROM ib) SELECT pair_address, i, round(exp(sum(ln(1 + r)) OVER (PARTITION BY pair_address ORDER BY i)), 6) AS equity FROM r WHERE r IS NOT NULL"


def equity(t):
    r = R.numbered(t.bars).select(P, "i", F.least(F.greatest(F.col("close") / F.lag("close").over(R.w()) - 1, F.lit(-0.9)), F.lit(1.0)).alias("r")).where("r is not null")
    return rounded(r.select(P, "i", F.exp(F.sum(F.log1p("r")).over(R.w())).alias("equity")))


for _name in ("equity_curve", "equity_curve_all"):  # two names of one query
    query(_name, _EQUITY)(equity)


@query("average_rank", "SELECT pair_address, day, CAST(rank() OVER (PARTITION BY day ORDER BY n) + (count(*) OVER (PARTITION BY day, n) - 1) / 2.0 AS DOUBLE) AS r, round((rank() OVER (PARTITION BY day ORDER BY n) + (count(*) OVER (PARTITION BY day, n) - 1) / 2.0) / count(*) OVER (PARTITION BY day), 6) AS pct FROM bars")
def _(t):
    r = average_rank(F.col("n"), ["day"])
    return rounded(t.bars.select(P, "day", r.cast("double").alias("r"), (r / F.count("*").over(Window.partitionBy("day"))).alias("pct")))


@query("cross_section_z", "SELECT pair_address, day, round((close - avg(close) OVER d) / nullif(stddev_samp(close) OVER d, 0), 6) AS z FROM bars WINDOW d AS (PARTITION BY day)")
def _(t):
    d = Window.partitionBy("day")
    return rounded(t.bars.select(P, "day", F.try_divide(F.col("close") - F.avg("close").over(d), F.nullif(F.stddev_samp("close").over(d), F.lit(0.0))).alias("z")))


@query("autocorrelation", f"WITH {_IB}, r AS (SELECT pair_address, i, close / {_lag('close')} - 1 AS r FROM ib), l AS (SELECT pair_address, r, {_lag('r')} AS p FROM r) SELECT pair_address, round(corr(r, p), 6) AS ac FROM l GROUP BY 1")
def _(t):
    r = R.numbered(t.bars).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1).withColumn("p", F.lag("r").over(R.w()))
    return rounded(r.where("p is not null").groupBy(P).agg(correlation("r", "p").alias("ac")))


@query("age_fan", f"WITH {_IB}, x AS (SELECT i, close / first_value(close) OVER (PARTITION BY pair_address ORDER BY i) AS v FROM ib) SELECT i, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95 FROM x GROUP BY 1")
def _(t):
    x = R.numbered(t.bars).select("i", (F.col("close") / F.first("close").over(R.w())).alias("v"))
    return rounded(x.groupBy("i").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), *[F.percentile("v", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)]))


@query("survivorship", "WITH x AS (SELECT pair_address, day, close, max(close) OVER (PARTITION BY pair_address ORDER BY day) AS peak, ln(close / lag(close) OVER (PARTITION BY pair_address ORDER BY day)) AS lr FROM bars) SELECT pair_address, round(arg_max(close, day) / arg_min(close, day) - 1, 6) AS total, round(arg_max(close / peak, day) - 1, 6) AS drawdown, round(stddev_pop(lr), 6) AS vol FROM x GROUP BY 1")
def _(t):
    o = Window.partitionBy(P).orderBy("day")
    x = t.bars.select(P, "day", "close", F.max("close").over(o).alias("peak"), F.log(F.col("close") / F.lag("close").over(o)).alias("lr"))
    return rounded(x.groupBy(P).agg((F.max_by("close", "day") / F.min_by("close", "day") - 1).alias("total"), (F.max_by(F.col("close") / F.col("peak"), "day") - 1).alias("drawdown"), F.stddev_pop("lr").alias("vol")))


@query("dead_pools", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY pair_address ORDER BY day DESC) AS r FROM bars) SELECT pair_address, round(avg(volume) FILTER (WHERE r <= 5), 4) AS recent, round(max(volume), 4) AS peak, avg(volume) FILTER (WHERE r <= 5) < 0.3 * max(volume) AS dead FROM x GROUP BY 1")
def _(t):
    x = t.bars.withColumn("r", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("day"))))
    recent = F.avg(F.when(F.col("r") <= 5, F.col("volume")))
    return rounded(x.groupBy(P).agg(recent.alias("recent"), F.max("volume").alias("peak"), (recent < 0.3 * F.max("volume")).alias("dead")), 4)


@query("buy_and_hold", "SELECT pair_address, count(*) AS n, round(arg_max(close, day) / arg_min(close, day) - 1, 6) AS bh, round(max(high) / arg_min(close, day) - 1, 6) AS mfe, round(min(low) / arg_min(close, day) - 1, 6) AS mae FROM bars GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    first = F.min_by("close", "day")
    return rounded(t.bars.groupBy(P).agg(F.count("*").alias("n"), (F.max_by("close", "day") / first - 1).alias("bh"), (F.max("high") / first - 1).alias("mfe"), (F.min("low") / first - 1).alias("mae")).where("n >= 10"))


@query("stable_exclusion", "WITH r AS (SELECT pair_address, close / lag(close) OVER (PARTITION BY pair_address ORDER BY day) - 1 AS r FROM bars) SELECT pair_address, count(*) AS n, round(stddev_samp(r), 6) AS sd FROM r GROUP BY 1 HAVING stddev_samp(r) > 0.01 AND count(*) >= 40")
def _(t):
    r = R.numbered(t.bars).select(P, (F.col("close") / F.lag("close").over(R.w()) - 1).alias("r"))
    return rounded(r.groupBy(P).agg(F.count("*").alias("n"), F.stddev_samp("r").alias("sd")).where("sd > 0.01 and n >= 40"))


@query("launch_cohort", "WITH x AS (SELECT pair_address, min(day) AS first, max(day) AS last, count(*) AS n FROM bars GROUP BY 1), g AS (SELECT max(day) AS edge FROM bars) SELECT pair_address, CAST(edge - first AS BIGINT) AS age, n FROM x, g WHERE n >= 20 AND abs((edge - first) - n * 1.6) <= 200")
def _(t):
    x = t.bars.groupBy(P).agg(F.min("day").alias("first"), F.count("*").alias("n"))
    edge = F.broadcast(t.bars.agg(F.max("day").alias("edge")))  # one row
    return x.join(edge).select(P, F.datediff("edge", "first").cast("long").alias("age"), "n").where("n >= 20 and abs(age - n * 1.6) <= 200")


# Simulation: the same rules as one recursive walk in SQL
def _sim_sql(family, tp, sl, hold, gap=2, both="-{sl}", extra=""):
    both = both.format(tp=tp, sl=sl)
    return f"""WITH RECURSIVE {_IB}, {_entries(family)}, sized AS (SELECT pair_address, i, entry, close, low, high, count(*) OVER (PARTITION BY pair_address) AS n FROM sig),
c AS (SELECT a.pair_address, a.i, a.close, a.n, least(a.i + {hold}, a.n - 1) AS last, min(b.i) AS hit FROM sized a LEFT JOIN sized b ON b.pair_address = a.pair_address AND b.i > a.i AND b.i <= least(a.i + {hold}, a.n - 1) AND (b.low <= a.close * {1 - sl!r} OR b.high >= a.close * {1 + tp!r}) WHERE a.entry AND a.i < a.n - 1 GROUP BY ALL),
o AS (SELECT *, coalesce(hit + 1, last + {gap}) AS free, row_number() OVER (PARTITION BY pair_address ORDER BY i) AS k FROM c),
w AS (SELECT pair_address, k, i, free, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.pair_address, o.k, o.i, CASE WHEN o.i >= w.free THEN o.free ELSE w.free END, o.i >= w.free FROM w JOIN o ON o.pair_address = w.pair_address AND o.k = w.k + 1),
t AS (SELECT o.pair_address, o.i, z.i AS j, CASE WHEN o.hit IS NULL THEN z.close / o.close - 1 WHEN z.low <= o.close * {1 - sl!r} AND z.high >= o.close * {1 + tp!r} THEN {both} WHEN z.low <= o.close * {1 - sl!r} THEN -{sl} ELSE {tp} END AS ret FROM w JOIN o USING (pair_address, k) JOIN ib z ON z.pair_address = o.pair_address AND z.i = coalesce(o.hit, o.last) WHERE w.kept)
{extra or 'SELECT pair_address, i, j, round(ret, 6) AS ret FROM t'}"""


_CAST = "SELECT pair_address, i, j, round(CAST(ret AS DOUBLE), 6) AS ret FROM t"
for _name, _args, _kw, _sql in (
    ("simulate_bracket", (0.15, 0.1, 10), {}, {}),
    ("simulate_no_gap", (0.15, 0.1, 10), {"time_exit_gap": False}, {"gap": 1}),
    ("simulate_tp_first", (0.05, 0.05, 10), {"rule": "tp_first"}, {"both": "{tp}"}),
    ("simulate_split", (0.05, 0.05, 10), {"rule": "split"}, {"both": "({tp} - {sl}) / 2"}),
):
    query(_name, _sim_sql("roc_rev", *_args, **_sql, extra=_CAST))(lambda t, a=_args, kw=_kw: rounded(R.simulate(R.signal(ib(t), "roc_rev"), *a, **kw).select(P, "i", "j", "ret")))


@query("pair_report", _sim_sql("roc_rev", 0.15, 0.1, 10, extra="SELECT pair_address, count(*) AS n, round(sum(ret - 0.01), 6) AS net, round(avg(ret - 0.01), 6) AS avg_trade, round(CASE WHEN sum(CASE WHEN ret < 0.01 THEN ret - 0.01 ELSE 0 END) < 0 THEN sum(CASE WHEN ret > 0.01 THEN ret - 0.01 ELSE 0 END) / -sum(CASE WHEN ret < 0.01 THEN ret - 0.01 ELSE 0 END) WHEN sum(CASE WHEN ret > 0.01 THEN ret - 0.01 ELSE 0 END) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 6) AS pf FROM t GROUP BY 1"))
def _(t):
    return rounded(R.score(R.simulate(R.signal(ib(t), "roc_rev"), 0.15, 0.1, 10), [P], 0.01))


@query("cost_grid", _sim_sql("roc_rev", 0.15, 0.1, 10, extra="SELECT m / 4.0 AS mult, count(*) AS n, round(sum(ret - 0.004 * m), 6) AS net FROM t, range(0, 9) g(m) GROUP BY 1"))
def _(t):
    trades = R.simulate(R.signal(ib(t), "roc_rev"), 0.15, 0.1, 10)
    grid = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("m")
    return rounded(trades.select("ret", grid).groupBy((F.col("m") / 4.0).alias("mult")).agg(F.count("*").alias("n"), F.sum(F.col("ret") - 0.004 * F.col("m")).alias("net")))


@query("close_to_close", f"""WITH RECURSIVE {_IB}, {_entries('donchian_bo')}, o AS (SELECT pair_address, i, close, least(i + 5, n - 1) AS last, row_number() OVER (PARTITION BY pair_address ORDER BY i) AS k FROM (SELECT pair_address, i, entry, close, count(*) OVER (PARTITION BY pair_address) AS n FROM sig) WHERE entry AND i < n - 1),
w AS (SELECT pair_address, k, last + 1 AS free, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.pair_address, o.k, CASE WHEN o.i >= w.free THEN o.last + 1 ELSE w.free END, o.i >= w.free FROM w JOIN o ON o.pair_address = w.pair_address AND o.k = w.k + 1)
SELECT o.pair_address, o.i, z.i AS j, round(z.close / o.close - 1, 6) AS ret FROM w JOIN o USING (pair_address, k) JOIN ib z ON z.pair_address = o.pair_address AND z.i = o.last WHERE kept""")
def _(t):
    return rounded(R.close_to_close(R.signal(ib(t), "donchian_bo"), 5))


# Nulls
_BAR_SHUFFLE = f"WITH {_IB}, s AS (SELECT pair_address, i, close, row_number() OVER (PARTITION BY pair_address ORDER BY md5(concat_ws('|', 'null', pair_address, CAST(i AS STRING))), i) - 1 AS k FROM ib) SELECT a.pair_address, a.i, b.close FROM s a JOIN s b ON b.pair_address = a.pair_address AND b.k = a.i"
for _name in ("null_bar_shuffle", "null_bar_shuffle_all"):  # two names of one query
    query(_name, _BAR_SHUFFLE)(lambda t: R.shuffled(R.numbered(t.bars).select(P, "i", "close"), "null", [P], ["close"]).select(P, "i", "close"))


@query("null_across_pairs", "WITH s AS (SELECT day, pair_address, close, row_number() OVER (PARTITION BY day ORDER BY pair_address) AS a, row_number() OVER (PARTITION BY day ORDER BY md5(concat_ws('|', 'x', CAST(day AS STRING), pair_address)), pair_address) AS b FROM bars) SELECT p.day, p.pair_address, q.close FROM s p JOIN s q ON q.day = p.day AND q.b = p.a")
def _(t):
    return R.shuffled(t.bars.select("day", P, "close"), "x", ["day"], ["close"], place=P).select("day", P, "close")


@query("null_random_k", "SELECT day, pair_address FROM (SELECT day, pair_address, row_number() OVER (PARTITION BY day ORDER BY md5(concat_ws('|', 'k', CAST(day AS STRING), pair_address)), pair_address) AS r FROM bars) WHERE r <= 3")
def _(t):
    key = hash_order("k", F.col("day"), F.col(P))
    return t.bars.select("day", P, F.row_number().over(Window.partitionBy("day").orderBy(key, P)).alias("r")).where("r <= 3").select("day", P)


@query("permutation_p", "WITH d AS (SELECT day, sum(volume) AS v, sum(n) AS n FROM bars GROUP BY 1), real AS (SELECT sum(v) FILTER (WHERE n >= 20) AS s FROM d), g AS (SELECT k, sum(v) AS s FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', 'p', CAST(k AS STRING), CAST(day AS STRING))), day) AS r FROM d, range(0, 20) t(k)) WHERE r <= (SELECT count(*) FROM d WHERE n >= 20) GROUP BY 1) SELECT count(*) AS seeds, round((1 + count(*) FILTER (WHERE g.s >= real.s)) / CAST(count(*) + 1 AS DOUBLE), 6) AS p, round((max(real.s) - avg(g.s)) / stddev_pop(g.s), 4) AS z FROM g, real")
def _(t):
    """Where a permutation picks the same days, it has the same sum to the last bit: p counts it, and without any spread there is no z."""
    d = materialised(t.bars.groupBy("day").agg(F.sum("volume").alias("v"), F.sum("n").alias("n")))
    day = F.col("day")
    real = d.agg(ordered_sum(F.when(F.col("n") >= 20, F.col("v")), day).alias("s"), F.count_if(F.col("n") >= 20).alias("picked"))
    seeds = d.select("day", "v", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(hash_order("p", F.col("k"), day), "day")))
    g = seeds.join(F.broadcast(real)).where("r <= picked").groupBy("k", "s").agg(ordered_sum(F.col("v"), day).alias("null"))  # real: one row
    n, over = F.count("*"), F.col("null") - F.col("s")
    return g.agg(n.alias("seeds"), F.round(R.p_value(F.col("s"), F.col("null"), n), 6).alias("p"), F.round(F.try_divide(F.lit(0.0) - F.avg(over), F.nullif(F.stddev_pop(over), F.lit(0.0))), 4).alias("z"))


# Cross-section
_PANEL = """f AS (SELECT pair_address, day, day - DATE '1990-01-01' AS d, close FROM bars), g AS (SELECT a.pair_address, a.day, a.d, a.close, b.close / a.close - 1 AS fwd, a.close / c.close - 1 AS mom FROM f a LEFT JOIN f b ON b.pair_address = a.pair_address AND b.d = a.d + 7 LEFT JOIN f c ON c.pair_address = a.pair_address AND c.d = a.d - 7)"""


def panel(t):
    """Bars with the return of the past and the next 7 calendar days, null where the other day has no bar."""
    f = t.bars.select(P, "day", F.datediff("day", F.lit("1990-01-01").cast("date")).alias("d"), "close")
    later = f.select(P, (F.col("d") - 7).alias("d"), F.col("close").alias("after"))
    earlier = f.select(P, (F.col("d") + 7).alias("d"), F.col("close").alias("before"))
    x = f.join(later, [P, "d"], "left").join(earlier, [P, "d"], "left")
    return x.select(P, "day", "d", "close", (F.col("after") / F.col("close") - 1).alias("fwd"), (F.col("close") / F.col("before") - 1).alias("mom"))


@query("forward_returns", f"WITH {_PANEL} SELECT pair_address, d, round(fwd, 6) AS fwd, round(mom, 6) AS mom FROM g")
def _(t):
    return rounded(panel(t).select(P, "d", "fwd", "mom"))


for _n2, _desc in (("momentum_top_k", True), ("reversal_top_k", False)):
    query(_n2, f"WITH {_PANEL}, a AS (SELECT *, count(*) OVER (PARTITION BY d) AS m, row_number() OVER (PARTITION BY d ORDER BY mom {'DESC' if _desc else 'ASC'}, pair_address) AS r FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL AND d % 7 = 0) SELECT d, count(*) AS k, round(sum(fwd - 0.0151), 6) AS net FROM a WHERE r <= 3 AND m >= 6 GROUP BY 1")(
        lambda t, desc=_desc: rounded(R.top_k(panel(t).where("fwd is not null and d % 7 = 0"), "d", F.col("mom"), 3, descending=desc).groupBy("d").agg(F.count("*").alias("k"), F.sum(F.col("fwd") - 0.0151).alias("net")))
    )


@query("winsorised_edge", f"WITH {_PANEL}, c AS (SELECT d, quantile_cont(fwd, 0.95) AS cap, median(fwd) AS bench FROM g WHERE fwd IS NOT NULL GROUP BY 1) SELECT d, round(avg(least(fwd, cap)) - max(bench), 6) AS edge, count(*) AS n FROM g JOIN c USING (d) WHERE fwd IS NOT NULL AND mom > 0.2 GROUP BY 1")
def _(t):
    x = panel(t).where("fwd is not null")
    c = x.groupBy("d").agg(F.percentile("fwd", 0.95).alias("cap"), F.median("fwd").alias("bench"))
    return rounded(x.where("mom > 0.2").join(c, "d").groupBy("d").agg((F.avg(F.least("fwd", "cap")) - F.max("bench")).alias("edge"), F.count("*").alias("n")))


@query("rank_ic", f"WITH {_PANEL}, a AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY mom) + (count(*) OVER (PARTITION BY d, mom) - 1) / 2.0 AS x, rank() OVER (PARTITION BY d ORDER BY fwd) + (count(*) OVER (PARTITION BY d, fwd) - 1) / 2.0 AS y FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL), c AS (SELECT d, corr(x, y) AS ic, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS dates, round(avg(ic), 6) AS ic, round(avg(ic) / stddev_pop(ic) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS win FROM c")
def _(t):
    x = panel(t).where("fwd is not null and mom is not null").select("d", average_rank(F.col("mom"), ["d"]).alias("x"), average_rank(F.col("fwd"), ["d"]).alias("y"))
    c = x.groupBy("d").agg(correlation("x", "y").alias("ic"), F.count("*").alias("n")).where("n >= 5")
    return c.agg(F.count("*").alias("dates"), F.round(F.avg("ic"), 6).alias("ic"), F.round(F.avg("ic") / F.stddev_pop("ic") * F.sqrt(F.count("*")), 4).alias("t"), F.round(F.avg((F.col("ic") > 1e-9).cast("double")), 6).alias("win"))


_DECILES = f"WITH {_PANEL}, a AS (SELECT fwd, ntile(10) OVER (ORDER BY mom, pair_address, d) AS decile FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT decile, count(*) AS n, round(median(fwd), 6) AS med FROM a GROUP BY 1"


def decile_medians(t):
    """Ranks within ranges of mom, so that no window holds all rows."""
    x = panel(t).where("fwd is not null and mom is not null").select(P, "d", "mom", "fwd")
    n = max(2, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = x.agg(F.percentile_approx("mom", [k / n for k in range(1, n)], 10_000).alias("cuts"))
    x = x.join(F.broadcast(cuts)).withColumn("range", F.expr("size(filter(cuts, c -> c < mom))")).drop("cuts")  # cuts: one row
    # a row for each range
    sizes = x.groupBy("range").agg(F.count("*").alias("n"))
    o = Window.partitionBy(F.lit(0))
    before = sizes.select("range", (F.sum("n").over(o.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(o).alias("total"))
    x = x.join(F.broadcast(before), "range").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("mom", P, "d")) - 1)
    # the first total % 10 deciles have one row more
    x = x.withColumn("decile", F.expr("int(if(r < total % 10 * (total div 10 + 1), r div (total div 10 + 1), total % 10 + try_divide(r - total % 10 * (total div 10 + 1), total div 10))) + 1"))
    return rounded(x.groupBy("decile").agg(F.count("*").alias("n"), F.median("fwd").alias("med")))


for _name in ("decile_medians", "decile_medians_all"):  # two names of one query
    query(_name, _DECILES)(decile_medians)


@query("best_coin_per_day", "SELECT day, max(close) AS close, arg_max(pair_address, close) AS pair_address FROM bars GROUP BY 1")
def _(t):
    return t.bars.groupBy("day").agg(F.max("close").alias("close"), F.max_by("pair_address", "close").alias("pair_address"))


@query("price_features", f"""WITH {_IB}, a AS (SELECT pair_address, i, close, high, low, volume, close / {_lag('close')} - 1 AS r FROM ib), b AS (SELECT pair_address, i, close / {_lag('close', 5)} - 1 AS ret5, close / {_lag('close', 20)} - 1 AS ret20, {_n('stddev_samp', 'r', 20)} AS vol20, {_n('avg', 'abs(r) / volume', 20)} AS amihud, {_n('avg', 'volume', 5)} / {_n('avg', 'volume', 20)} AS voltrend, close / {_n('max', 'high', 20)} - 1 AS maxdd, {_n('avg', '(high - low) / close', 20)} AS rng, close / {_n('avg', 'close', 20)} - 1 AS above FROM a)
SELECT pair_address, i, round({_lag('ret5')}, 6) AS ret5, round({_lag('ret20')}, 6) AS ret20, round({_lag('vol20')}, 6) AS vol20, round(1e6 * {_lag('amihud')}, 6) AS amihud, round({_lag('voltrend')}, 6) AS voltrend, round({_lag('maxdd')}, 6) AS maxdd, round({_lag('rng')}, 6) AS rng, round({_lag('above')}, 6) AS above FROM b""")
def _(t):
    a = R.numbered(t.bars).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1)
    c, v = F.col("close"), F.col("volume")
    b = a.select(P, "i", R.roc(5).alias("ret5"), R.roc(20).alias("ret20"), rolling(F.stddev_samp, F.col("r"), R.w(), 20).alias("vol20"), (1e6 * rolling(F.avg, F.abs("r") / v, R.w(), 20)).alias("amihud"), (R.sma("volume", 5) / R.sma("volume", 20)).alias("voltrend"), (c / rolling(F.max, F.col("high"), R.w(), 20) - 1).alias("maxdd"), rolling(F.avg, (F.col("high") - F.col("low")) / c, R.w(), 20).alias("rng"), (c / R.sma("close", 20) - 1).alias("above"))
    return rounded(b.select(P, "i", *[F.lag(f).over(R.w()).alias(f) for f in b.columns[2:]]))


# Portfolios
_RET = f"r AS (SELECT pair_address, day, least(greatest(close / {_lag('close')} - 1, -0.9), 1) AS r FROM ib)"


def daily_returns(t):
    return R.numbered(t.bars).select(P, "day", F.least(F.greatest(F.col("close") / F.lag("close").over(R.w()) - 1, F.lit(-0.9)), F.lit(1.0)).alias("r")).where("r is not null")


@query("basket_returns", f"WITH {_IB}, {_RET} SELECT day, count(*) AS live, round(avg(r), 6) AS ew, round(sum(r * reserve_usd) / sum(reserve_usd), 6) AS rw FROM r JOIN meta USING (pair_address) WHERE r IS NOT NULL GROUP BY 1")
def _(t):
    x = daily_returns(t).join(t.meta.select(P, "reserve_usd"), P)
    return rounded(x.groupBy("day").agg(F.count("*").alias("live"), F.avg("r").alias("ew"), (F.sum(F.col("r") * F.col("reserve_usd")) / F.sum("reserve_usd")).alias("rw")))


@query("basket_turnover_cost", f"WITH {_IB}, {_RET}, d AS (SELECT day, avg(r) AS ew FROM r WHERE r IS NOT NULL GROUP BY 1), n AS (SELECT day, ew, row_number() OVER (ORDER BY day) - 1 AS k FROM d) SELECT day, round(ew - CASE WHEN k % 7 = 0 THEN 0.0151 ELSE 0 END, 6) AS net FROM n")
def _(t):
    d = daily_returns(t).groupBy("day").agg(F.avg("r").alias("ew"))
    n = d.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1)  # one row a day
    return rounded(n.select("day", (F.col("ew") - F.when(F.col("k") % 7 == 0, 0.0151).otherwise(0.0)).alias("net")))


@query("rolling_beta", f"""WITH {_IB}, {_RET}, m AS (SELECT day, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY 1), x AS (SELECT r.pair_address, r.day, r.r, m.m FROM r JOIN m USING (day) WHERE r.r IS NOT NULL)
SELECT pair_address, day, round(least(greatest(covar_samp(r, m) OVER w / nullif(var_pop(m) OVER w, 0), -3), 3), 6) AS beta FROM x WINDOW w AS (PARTITION BY pair_address ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 20""")
def _(t):
    r = daily_returns(t)
    x = r.join(r.groupBy("day").agg(F.avg("r").alias("m")), "day")
    w = Window.partitionBy(P).orderBy("day").rowsBetween(-59, 0)
    beta = F.covar_samp("r", "m").over(w) / F.nullif(F.var_pop("m").over(w), F.lit(0.0))
    return rounded(x.select(P, "day", F.least(F.greatest(beta, F.lit(-3.0)), F.lit(3.0)).alias("beta"), F.count("*").over(w).alias("c")).where("c >= 20").drop("c"))


@query("metrics_geometric", f"""WITH {_IB}, {_RET}, c AS (SELECT pair_address, day, r, exp(sum(ln(1 + r)) OVER (PARTITION BY pair_address ORDER BY day)) AS e FROM r WHERE r > -0.9), d AS (SELECT *, e / max(e) OVER (PARTITION BY pair_address ORDER BY day) - 1 AS dd FROM c),
a AS (SELECT pair_address, count(*) AS n, exp(sum(ln(1 + r)) * 365 / count(*)) - 1 AS ann, stddev_samp(r) * sqrt(365) AS vol, avg(r) * 365 AS m, min(dd) AS dd FROM d GROUP BY 1)
SELECT pair_address, n, round(ann_ret, 4) AS ann_ret, round(vol, 4) AS ann_vol, round(m / nullif(vol, 0), 4) AS sharpe, round(dd, 4) AS max_dd, round(ann_ret / nullif(-dd, 0), 4) AS calmar FROM (SELECT *, ann AS ann_ret FROM a)""")
def _(t):
    return rounded(R.metrics(daily_returns(t).where("r > -0.9"), [P], "day", "r", geometric=True), 4)


@query("metrics_arithmetic", f"""WITH {_IB}, {_RET}, c AS (SELECT pair_address, day, r, sum(r) OVER (PARTITION BY pair_address ORDER BY day) AS e FROM r WHERE r IS NOT NULL), d AS (SELECT *, e - max(e) OVER (PARTITION BY pair_address ORDER BY day) AS dd FROM c),
a AS (SELECT pair_address, count(*) AS n, avg(r) * 365 AS ann, stddev_samp(r) * sqrt(365) AS vol, min(dd) AS dd FROM d GROUP BY 1)
SELECT pair_address, n, round(ann, 4) AS ann_ret, round(vol, 4) AS ann_vol, round(ann / nullif(vol, 0), 4) AS sharpe, round(dd, 4) AS max_dd, round(ann / nullif(-dd, 0), 4) AS calmar FROM a""")
def _(t):
    return rounded(R.metrics(daily_returns(t), [P], "day", "r", geometric=False), 4)


@query("participation_ratio", f"""WITH {_IB}, {_RET}, v AS (SELECT pair_address, day, r FROM r WHERE r IS NOT NULL), g AS (SELECT p.pair_address, d.day, coalesce(v.r, 0) AS r FROM (SELECT DISTINCT pair_address FROM v) p CROSS JOIN (SELECT DISTINCT day FROM v) d LEFT JOIN v ON v.pair_address = p.pair_address AND v.day = d.day), c AS (SELECT a.pair_address AS a, b.pair_address AS b, corr(a.r, b.r) AS c FROM g a JOIN g b ON a.day = b.day AND a.pair_address < b.pair_address GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT pair_address) FROM v) AS n, round((SELECT count(DISTINCT pair_address) FROM v) ** 2 / ((SELECT count(DISTINCT pair_address) FROM v) + 2 * sum(c * c)), 4) AS participation, round(median(abs(c)), 4) AS median_abs_corr FROM c""")
def _(t):
    return rounded(R.participation_ratio(daily_returns(t), P, "day", "r"), 4)


@query("inverse_vol_weights", f"WITH {_IB}, {_RET}, s AS (SELECT pair_address, date_trunc('month', day) AS m, stddev_samp(r) AS sd, avg(r) AS mu, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4 AND avg(r) > 0 AND stddev_samp(r) > 0) SELECT pair_address, CAST(m AS DATE) AS m, round(1 / sd / sum(1 / sd) OVER (PARTITION BY m), 6) AS iv, round(1.0 / count(*) OVER (PARTITION BY m), 6) AS ew FROM s")
def _(t):
    s = daily_returns(t).groupBy(P, F.trunc("day", "month").alias("m")).agg(F.stddev_samp("r").alias("sd"), F.avg("r").alias("mu"), F.count("*").alias("n")).where("n >= 4 and mu > 0 and sd > 0")
    m = Window.partitionBy("m")
    return rounded(s.select(P, "m", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(m)).alias("iv"), (F.lit(1.0) / F.count("*").over(m)).alias("ew")))


@query("vol_target_scale", f"WITH {_IB}, {_RET}, d AS (SELECT day, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY 1), s AS (SELECT day, r, CASE WHEN count(*) OVER w = 30 THEN stddev_samp(r) OVER w END AS sd FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT day, round(coalesce(least(0.02 / nullif(lag(sd) OVER (ORDER BY day), 0), 5), 1), 6) AS scale FROM s")
def _(t):
    o = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    d = daily_returns(t).groupBy("day").agg(F.avg("r").alias("r")).withColumn("sd", rolling(F.stddev_samp, F.col("r"), o, 30))
    return rounded(d.select("day", F.coalesce(F.least(0.02 / F.nullif(F.lag("sd").over(o), F.lit(0.0)), F.lit(5.0)), F.lit(1.0)).alias("scale")))


@query("capped_book", _sim_sql("roc_rev", 0.15, 0.1, 10, extra="SELECT a AS aum, count(*) AS n, round(sum(least(a / 25.0, 0.0025 * reserve_usd * 100) * ret), 2) AS pnl FROM t JOIN meta USING (pair_address), range(10000, 100001, 10000) g(a) GROUP BY 1"))
def _(t):
    trades = R.simulate(R.signal(ib(t), "roc_rev"), 0.15, 0.1, 10).join(t.meta.select(P, "reserve_usd"), P)
    x = trades.select("ret", "reserve_usd", F.explode(F.sequence(F.lit(10000).cast("long"), F.lit(100000).cast("long"), F.lit(10000).cast("long"))).alias("aum"))
    return rounded(x.groupBy("aum").agg(F.count("*").alias("n"), F.sum(F.least(F.col("aum") / 25.0, 0.0025 * F.col("reserve_usd") * 100) * F.col("ret")).alias("pnl")), 2)


@query("stream_daily", _sim_sql("roc_rev", 0.15, 0.1, 10, extra="SELECT z.day, round(avg(ret), 6) + 0.0 AS ret, count(*) AS n FROM t JOIN ib z ON z.pair_address = t.pair_address AND z.i = t.j GROUP BY 1"))
def _(t):
    b = ib(t)
    trades = R.simulate(R.signal(b, "roc_rev"), 0.15, 0.1, 10)
    return trades.join(b.select(P, F.col("i").alias("j"), "day"), [P, "j"]).groupBy("day").agg((F.round(F.avg("ret"), 6) + F.lit(0.0)).alias("ret"), F.count("*").alias("n"))


# Liquidity providing
@query("lp_full_range", f"WITH {_IB}, x AS (SELECT pair_address, i, close, volume, close / {_lag('close')} - 1 AS r FROM ib) SELECT pair_address, count(*) - 1 AS n, round(sum(least(volume, 300000) * 0.003 * 1000 / 101000) FILTER (WHERE i > 0), 4) AS fees, round(2 * sqrt(arg_max(close, i) / arg_min(close, i)) / (1 + arg_max(close, i) / arg_min(close, i)) - 1, 6) AS il, round(0.125 * sum(r * r), 4) AS lvr FROM x GROUP BY 1")
def _(t):
    x = R.numbered(t.bars).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1)
    ratio = F.max_by("close", "i") / F.min_by("close", "i")
    out = x.groupBy(P).agg((F.count("*") - 1).alias("n"), F.round(F.sum(F.when(F.col("i") > 0, F.least("volume", F.lit(300000.0)) * 0.003 * 1000 / 101000)), 4).alias("fees"), F.round(C.impermanent_loss(ratio), 6).alias("il"), F.round(0.125 * F.sum(F.col("r") * F.col("r")), 4).alias("lvr"))
    return out


@query("lp_yield_rank", "WITH y AS (SELECT pair_address, date_trunc('year', day) AS y, sum(volume) / (SELECT sum(reserve_usd) FROM meta WHERE meta.pair_address = bars.pair_address) AS yld FROM bars GROUP BY 1, 2) SELECT CAST(y AS DATE) AS y, pair_address, round(yld, 6) AS yld FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY yld DESC, pair_address) AS r FROM y) WHERE r <= 5")
def _(t):
    y = t.bars.groupBy(P, F.trunc("day", "year").alias("y")).agg(F.sum("volume").alias("v")).join(t.meta.select(P, "reserve_usd"), P).withColumn("yld", F.col("v") / F.col("reserve_usd"))
    return rounded(y.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("yld"), P))).where("r <= 5").select("y", P, "yld"))


@query("null_control_rule", f"WITH {_IB}, r AS (SELECT pair_address, i, close / {_lag('close')} - 1 AS r FROM ib), h AS (SELECT pair_address, r, {_lag('r')} > 0 AS held FROM r) SELECT pair_address, count(*) FILTER (WHERE held AND r IS NOT NULL) AS n, round(CASE WHEN sum(r) FILTER (WHERE held AND r < 0) < 0 THEN coalesce(sum(r) FILTER (WHERE held AND r > 0), 0) / -sum(r) FILTER (WHERE held AND r < 0) END, 6) AS pf FROM h GROUP BY 1")
def _(t):
    r = R.numbered(t.bars).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1).withColumn("held", F.lag("r").over(R.w()) > 0).where("held and r is not null")
    s = R.score(r.withColumnRenamed("r", "ret"), [P])
    return rounded(s.select(P, "n", F.when(~F.col("pf").isin(float("inf")), F.col("pf")).alias("pf")))
