"""Queries of walk-forward evaluation and its controls: families and archetypes over windows, cross-coin folds, nulls, resampling, features and the ranker."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ammlytics.functions.ordered import running
from ammlytics.functions.rolling import average_rank, correlation, hash_order, rolling
from ammlytics.operators import ranking as K
from ammlytics.operators import research as R
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.plans.research import _EMA, _IB, _PANEL, _RAW, _RET, _SHIFT, _lag, _n, daily_returns, ib, panel
from ammlytics.session import materialised

P = "pair_address"
BRACKETS = [(0.15, 0.1, 10), (0.3, 0.2, 20), (0.05, 0.05, 5)]

_ALL = [f"SELECT pair_address, i, close, low, high, '{f}' AS family, {_SHIFT} AS entry FROM (SELECT *, {raw} AS raw FROM ib)" for f, raw in _RAW.items()]
_ALL_EMA = f"SELECT pair_address, i, close, low, high, 'ema_cross' AS family, {_SHIFT} AS entry FROM (SELECT b.*, e5.e > e21.e AS raw FROM ib b JOIN e5 USING (pair_address, i) JOIN e21 USING (pair_address, i))"
_ALL_PULL = f"SELECT pair_address, i, close, low, high, 'ma_pullback' AS family, {_SHIFT} AS entry FROM (SELECT *, ma > {_lag('ma', 3)} AND close < ma AND close > prev AS raw FROM (SELECT *, {_n('avg', 'close', 20)} AS ma FROM ib))"


def walk_sql(sigs: str, head: str, is_len: int, oos_len: int, least_is: int = 5, least_oos: int = 4) -> str:
    """The walk-forward rules in SQL: windows, non-overlapping trades in each part, the best bracket in sample, its trades out of sample."""
    g = ", ".join(f"({d}, {tp}, {sl}, {hold})" for d, (tp, sl, hold) in enumerate(BRACKETS))
    key = "pair_address, start, part, family, draw"
    pf = "CASE WHEN sum(least(ret, 0)) < 0 THEN sum(greatest(ret, 0)) / -sum(least(ret, 0)) WHEN sum(greatest(ret, 0)) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"
    return f"""WITH RECURSIVE {head}, sigs AS MATERIALIZED ({sigs}), nn AS (SELECT pair_address, count(*) AS n FROM ib GROUP BY 1), win AS (SELECT pair_address, unnest(range(0, n - {is_len + oos_len} + 1, {oos_len})) AS start FROM nn WHERE n >= {is_len + oos_len}),
parts AS (SELECT pair_address, start, 'is' AS part, start AS lo, start + {is_len} - 1 AS hi FROM win UNION ALL SELECT pair_address, start, 'oos', start + {is_len}, start + {is_len + oos_len} - 1 FROM win), g(draw, tp, sl, hold) AS (VALUES {g}),
e AS (SELECT p.*, s.family, s.i, s.close, g.* FROM sigs s JOIN parts p ON p.pair_address = s.pair_address AND s.i >= p.lo AND s.i < p.hi CROSS JOIN g WHERE s.entry),
c AS MATERIALIZED (SELECT e.*, least(e.i + hold, hi) AS last, min(b.i) AS hit FROM e LEFT JOIN ib b ON b.pair_address = e.pair_address AND b.i > e.i AND b.i <= e.i + 20 AND b.i <= least(e.i + hold, hi) AND (b.low <= e.close * (1 - sl) OR b.high >= e.close * (1 + tp)) GROUP BY ALL),
o AS MATERIALIZED (SELECT *, coalesce(hit + 1, last + 2) AS free, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k FROM c),
w AS (SELECT {key}, k, free, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.pair_address, o.start, o.part, o.family, o.draw, o.k, CASE WHEN o.i >= w.free THEN o.free ELSE w.free END, o.i >= w.free FROM w JOIN o ON o.pair_address = w.pair_address AND o.start = w.start AND o.part = w.part AND o.family = w.family AND o.draw = w.draw AND o.k = w.k + 1),
t AS (SELECT o.pair_address, o.start, o.part, o.family, o.draw, CAST(CASE WHEN o.hit IS NULL THEN z.close / o.close - 1 WHEN z.low <= o.close * (1 - sl) THEN -sl ELSE tp END AS DOUBLE) AS ret FROM w JOIN o USING ({key}, k) JOIN ib z ON z.pair_address = o.pair_address AND z.i = coalesce(o.hit, o.last) WHERE w.kept),
r AS (SELECT pair_address, family, start, draw, {pf} AS pf FROM t WHERE part = 'is' GROUP BY 1, 2, 3, 4 HAVING count(*) >= {least_is}), best AS (SELECT *, row_number() OVER (PARTITION BY pair_address, family, start ORDER BY round(pf, 9) DESC, draw) AS k FROM r)
SELECT pair_address, family, count(*) AS n, round(sum(ret), 9) AS net, round(avg(ret), 9) AS avg_trade, round({pf}, 9) AS pf, round({pf}, 9) > 1 AND round(sum(ret), 9) > 0 AS pass FROM t JOIN best USING (pair_address, family, start, draw) WHERE part = 'oos' AND best.k = 1 GROUP BY 1, 2 HAVING count(*) >= {least_oos}"""


TWO = " UNION ALL ".join(x for x in _ALL if "'boll_rev'" in x or "'donchian_bo'" in x)


@query("walk_forward", walk_sql(TWO, _IB, 240, 120))
def _(t):
    """Best bracket in sample, traded out of sample, by pair and family."""
    return rounded(R.walk_forward(ib(t), {"boll_rev": (20, 1.5), "donchian_bo": (20,)}, BRACKETS, is_len=240, oos_len=120), 9)


@query("walk_forward_families", walk_sql(" UNION ALL ".join([*_ALL, _ALL_EMA, _ALL_PULL]), f"{_IB}, {_EMA.format(n=5)}, {_EMA.format(n=21)}", 90, 45))
def _(t):
    """All 16 families over windows of 90 and 45 bars."""
    return rounded(R.walk_forward(ib(t), R.FAMILY_PARAMS, BRACKETS, is_len=90, oos_len=45), 9)


# Close-only stop and the archetypes
_ARCH = {
    "momentum": f"c1 / {_lag('c1', 5)} - 1 > 0.15",
    "breakout": f"c1 >= {_n('max', 'c1', 10)}",
    "reversion": f"(c1 - {_n('avg', 'c1', 10)}) / nullif({_n('stddev_samp', 'c1', 10)}, 0) < -1.5",
    "volsurge": f"v1 > 2.0 * {_n('avg', 'v1', 10)} AND c1 / {_lag('c1')} - 1 > 0",
}
_ARCH_ARGS = {"momentum": (5, 0.15), "breakout": (10, 0.0), "reversion": (10, 1.5), "volsurge": (10, 2.0)}


def _arch(name):
    return f"sig AS (SELECT *, coalesce({_ARCH[name]}, false) AS entry FROM (SELECT *, {_lag('close')} AS c1, {_lag('coalesce(volume, 0)')} AS v1 FROM ib))"


for _name in _ARCH:
    query(f"archetype_{_name}", f"WITH {_IB}, {_arch(_name)} SELECT pair_address, i FROM sig WHERE entry")(lambda t, n=_name: R.archetype(R.numbered(t.bars), n, *_ARCH_ARGS[n]).where("entry").select(P, "i"))


def _close_stop(name, stop, hold, extra, part="''", cut="true"):
    return f"""WITH RECURSIVE {_IB}, q AS (SELECT min(day) AS lo, max(day) AS hi FROM bars), {_arch(name)}, sz AS (SELECT sig.*, {part} AS part, count(*) OVER (PARTITION BY pair_address) AS nb FROM sig, q WHERE {cut}),
c AS MATERIALIZED (SELECT a.pair_address, a.part, a.i, a.close, coalesce(min(b.i), least(a.i + {hold}, a.nb - 1)) AS z FROM sz a LEFT JOIN ib b ON b.pair_address = a.pair_address AND b.i > a.i AND b.i <= least(a.i + {hold}, a.nb - 1) AND b.close <= a.close * {1 - stop!r} WHERE a.entry AND a.i < a.nb - 1 GROUP BY a.pair_address, a.part, a.i, a.close, a.nb),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_address, part ORDER BY i) AS k FROM c),
w AS (SELECT pair_address, part, k, z + 1 AS free, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.pair_address, o.part, o.k, CASE WHEN o.i >= w.free THEN o.z + 1 ELSE w.free END, o.i >= w.free FROM w JOIN o ON o.pair_address = w.pair_address AND o.part = w.part AND o.k = w.k + 1),
t AS (SELECT o.pair_address, o.part, o.i, o.z AS j, x.close / o.close - 1 AS ret FROM w JOIN o USING (pair_address, part, k) JOIN ib x ON x.pair_address = o.pair_address AND x.i = o.z WHERE w.kept) {extra}"""


@query("simulate_close_stop", _close_stop("reversion", 0.15, 7, "SELECT pair_address, i, j, round(ret, 6) AS ret FROM t"))
def _(t):
    return rounded(R.simulate_close_stop(R.archetype(R.numbered(t.bars), "reversion", 10, 1.5), 0.15, 7))


_PF = "CASE WHEN sum(least(ret - 0.01, 0)) FILTER (WHERE part = '{0}') < 0 THEN coalesce(sum(greatest(ret - 0.01, 0)) FILTER (WHERE part = '{0}'), 0) / -sum(least(ret - 0.01, 0)) FILTER (WHERE part = '{0}') WHEN sum(greatest(ret - 0.01, 0)) FILTER (WHERE part = '{0}') > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"
_SPLIT = "CASE WHEN day - lo < 0.6 * (hi - lo) THEN 'is' ELSE 'oos' END"
_COMBO = f"SELECT count(*) FILTER (WHERE part = 'is') AS is_n, count(*) FILTER (WHERE part = 'oos') AS oos_n, round({_PF.format('is')}, 6) AS is_pf, round({_PF.format('oos')}, 6) AS oos_pf, round(coalesce(sum(ret - 0.01) FILTER (WHERE part = 'oos'), 0), 6) AS oos_net FROM t"


def _combo_sql():
    return " UNION ALL ".join(f"SELECT '{a}' AS combo, * FROM ({_close_stop(a, stop, hold, _COMBO, part=_SPLIT)})" for a, stop, hold in _COMBOS)


_COMBOS = [(a, stop, hold) for a in _ARCH for stop, hold in ((0.15, 7),)]


@query("combo_walk_forward", f"SELECT *, is_pf > 1 AND is_n >= 20 AS chosen FROM ({_combo_sql()})")
def _(t):
    """Each archetype pooled over all pairs: in sample before 60 % of the calendar, out of sample after; chosen if it made money in sample."""
    bars = R.numbered(t.bars)
    edge = F.broadcast(t.bars.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))  # one row
    out = None
    for name, stop, hold in _COMBOS:
        # a signal outside a part's days is no entry there, but its bars are there for exits
        b = R.archetype(bars, name, *_ARCH_ARGS[name]).join(edge).withColumn("part", F.when(F.datediff("day", "lo") < 0.6 * F.datediff("hi", "lo"), "is").otherwise("oos"))
        trades = None
        for part in ("is", "oos"):
            one = R.simulate_close_stop(b.withColumn("entry", F.col("entry") & (F.col("part") == part)), stop, hold).withColumn("part", F.lit(part))
            trades = one if trades is None else trades.unionByName(one)
        net = F.col("ret") - 0.01
        side = lambda p, x: F.coalesce(F.sum(F.when(F.col("part") == p, x)), F.lit(0.0))
        pf = lambda p: R.profit_factor(side(p, F.greatest(net, F.lit(0.0))), side(p, F.least(net, F.lit(0.0))))
        one = trades.agg(F.count_if(F.col("part") == "is").alias("is_n"), F.count_if(F.col("part") == "oos").alias("oos_n"), pf("is").alias("is_pf"), pf("oos").alias("oos_pf"), side("oos", net).alias("oos_net")).select(F.lit(name).alias("combo"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out.withColumn("chosen", (F.col("is_pf") > 1) & (F.col("is_n") >= 20)))


# Pairs in order of their first bar: earlier pairs choose the bracket for later ones
_GRID = [(age, tp, sl) for age in (5, 20) for tp, sl in ((0.5, 0.3), (1.0, 0.5))]
_AGE = " UNION ALL ".join(f"SELECT {g} AS g, e.pair_address, CASE WHEN min(b.i) FILTER (WHERE b.low <= e.close * {1 - sl!r}) <= coalesce(min(b.i) FILTER (WHERE b.high >= e.close * {1 + tp!r}), 1000000000) THEN -{sl} WHEN min(b.i) FILTER (WHERE b.high >= e.close * {1 + tp!r}) IS NOT NULL THEN {tp} ELSE arg_max(b.close, b.i) / max(e.close) - 1 END AS ret FROM ib e JOIN ib b ON b.pair_address = e.pair_address AND b.i BETWEEN {age + 1} AND {age + 30} WHERE e.i = {age} GROUP BY 2" for g, (age, tp, sl) in enumerate(_GRID))


@query("cross_coin_walk_forward", f"WITH {_IB}, f AS (SELECT pair_address, (row_number() OVER (ORDER BY min(day), pair_address) - 1) * 5 // count(*) OVER () AS fold FROM bars GROUP BY 1), t AS (SELECT g, pair_address, CAST(ret AS DOUBLE) AS ret FROM ({_AGE})), x AS (SELECT t.*, fold FROM t JOIN f USING (pair_address)), k AS (SELECT unnest(range(1, 5)) AS test), s AS (SELECT test, g, avg(ret) AS m FROM x JOIN k ON fold < test GROUP BY 1, 2), b AS (SELECT test, arg_min(g, (-m, g)) AS g FROM s GROUP BY 1) SELECT b.test AS fold, b.g, count(*) AS n, round(avg(ret), 6) AS oos FROM b JOIN x ON x.fold = b.test AND x.g = b.g GROUP BY 1, 2")
def _(t):
    b = R.numbered(t.bars).select(P, "i", "high", "low", "close")
    trades = None
    for g, (age, tp, sl) in enumerate(_GRID):
        x = b.withColumn("ep", F.max(F.when(F.col("i") == age, F.col("close"))).over(Window.partitionBy(P))).where(f"i between {age + 1} and {age + 30} and ep is not null")
        stop, goal = (F.min(F.when(c, F.col("i"))) for c in (F.col("low") <= F.col("ep") * (1 - sl), F.col("high") >= F.col("ep") * (1 + tp)))
        one = x.groupBy(P).agg(stop.alias("s"), goal.alias("p"), F.max_by("close", "i").alias("last"), F.max("ep").alias("ep"))
        one = one.select(F.lit(g).alias("g"), P, F.when(F.col("s") <= F.coalesce("p", F.lit(1_000_000_000)), -sl).when(F.col("p").isNotNull(), tp).otherwise(F.col("last") / F.col("ep") - 1).alias("ret"))
        trades = one if trades is None else trades.unionByName(one)
    x = trades.join(R.folds(t.bars.groupBy(P).agg(F.min("day").alias("first")), ["first", P], 5).select(P, "fold"), P)
    # pooled means of the earlier folds, from a sum by fold and point
    s = x.groupBy("g", "fold").agg(F.sum("ret").alias("r"), F.count("*").alias("c"))
    test = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("test")
    s = s.select("*", test).where("fold < test").groupBy("test", "g").agg((F.sum("r") / F.sum("c")).alias("m"))
    best = s.groupBy("test").agg(F.min_by("g", F.struct((-F.col("m")).alias("m"), "g")).alias("g")).withColumnRenamed("test", "fold")
    return rounded(x.join(best, ["fold", "g"]).groupBy("fold", "g").agg(F.count("*").alias("n"), F.avg("ret").alias("oos")))


@query("noise_sweep")
def _(t):
    """The more draws the in-sample choice has, the better it looks there, on shuffled bars too."""
    b = R.numbered(t.bars)
    null = R.shuffled(b.select(P, "i", "open", "high", "low", "close", "volume"), "noise", [P], ["open", "high", "low", "close", "volume"])
    draws = [(0.05 * k, 0.05 * m, h) for k, m, h in ((1, 1, 5), (2, 1, 5), (3, 2, 10), (6, 4, 20))]
    return R.noise_sweep(R.base_columns(b), R.base_columns(null), {"roc_rev": (5, 0.1), "donchian_bo": (20,)}, draws, [1, 2, 4], is_len=240, oos_len=120, cost=0.01)


# Nulls
def _md5(seed, *x):
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS STRING)' for c in x)}))"


@query("null_ohlcv_shuffle", f"WITH {_IB}, s AS (SELECT *, row_number() OVER (PARTITION BY pair_address ORDER BY {_md5('bars', 'pair_address', 'i')}, i) - 1 AS k FROM ib) SELECT a.pair_address, a.i, b.open, b.high, b.low, b.close, b.volume FROM s a JOIN s b ON b.pair_address = a.pair_address AND b.k = a.i")
def _(t):
    """Whole bars change places within their pair; open to volume stay together."""
    values = ["open", "high", "low", "close", "volume"]
    return R.shuffled(R.numbered(t.bars).select(P, "i", *values), "bars", [P], values).select(P, "i", *values)


@query("null_labels_in_day", f"WITH {_PANEL}, l AS (SELECT d, pair_address, mom, fwd FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pair_address) AS a, row_number() OVER (PARTITION BY d ORDER BY {_md5('label', 'd', 'pair_address')}, pair_address) AS b FROM l) SELECT p.d, p.pair_address, round(p.mom, 6) AS mom, round(q.fwd, 6) AS fwd FROM s p JOIN s q ON q.d = p.d AND q.b = p.a")
def _(t):
    """The labels of a day change places, the features stay."""
    x = panel(t).where("mom is not null and fwd is not null").select("d", P, "mom", "fwd")
    return rounded(R.shuffled(x, "label", ["d"], ["fwd"], place=P).select("d", P, "mom", "fwd"))


@query("null_columns", f"WITH {_IB}, s AS (SELECT pair_address, i, close, volume, row_number() OVER (PARTITION BY pair_address ORDER BY {_md5('c', 'pair_address', 'i')}, i) - 1 AS x, row_number() OVER (PARTITION BY pair_address ORDER BY {_md5('v', 'pair_address', 'i')}, i) - 1 AS y FROM ib) SELECT a.pair_address, a.i, b.close, c.volume FROM s a JOIN s b ON b.pair_address = a.pair_address AND b.x = a.i JOIN s c ON c.pair_address = a.pair_address AND c.y = a.i")
def _(t):
    """Each column is shuffled for itself."""
    b = R.numbered(t.bars).select(P, "i", "close", "volume")
    return R.shuffled(b.select(P, "i", "close"), "c", [P], ["close"]).join(R.shuffled(b.select(P, "i", "volume"), "v", [P], ["volume"]), [P, "i"]).select(P, "i", "close", "volume")


@query("null_signals", f"WITH {_IB}, sig AS (SELECT *, {_SHIFT} AS entry FROM (SELECT *, {_RAW['roc_rev']} AS raw FROM ib)), s AS (SELECT pair_address, i, entry, close, row_number() OVER (PARTITION BY pair_address ORDER BY {_md5('sig', 'pair_address', 'i')}, i) - 1 AS k FROM sig) SELECT a.pair_address, count(*) FILTER (WHERE b.entry) AS n, round(sum(a.close) FILTER (WHERE b.entry), 4) AS closes FROM s a JOIN s b ON b.pair_address = a.pair_address AND b.k = a.i GROUP BY 1")
def _(t):
    """Entries change places within their pair, prices stay: as many entries as before, at other bars."""
    s = R.signal(ib(t), "roc_rev").select(P, "i", "entry", "close")
    return R.shuffled(s, "sig", [P], ["entry"]).groupBy(P).agg(F.count_if("entry").alias("n"), F.round(F.sum(F.when(F.col("entry"), F.col("close"))), 4).alias("closes"))


@query("null_relabelled", f"WITH p AS (SELECT pair_address, row_number() OVER (ORDER BY pair_address) AS a, row_number() OVER (ORDER BY {_md5('swap', 'pair_address')}, pair_address) AS b FROM (SELECT DISTINCT pair_address FROM bars)), m AS (SELECT x.pair_address AS own, y.pair_address AS given FROM p x JOIN p y ON y.b = x.a) SELECT own AS pair_address, day, close FROM bars JOIN m ON given = pair_address")
def _(t):
    """Whole series change owners."""
    pairs = t.bars.select(P).distinct()
    own = running(pairs.select(F.col(P).alias("own")), [], ["own"], {"k": F.lit(1)})
    given = running(pairs.withColumn("h", hash_order("swap", F.col(P))), [], ["h", P], {"k": F.lit(1)}).drop("h")
    return t.bars.join(own.join(given, "k").drop("k"), P).select(F.col("own").alias(P), "day", "close")


@query("block_bootstrap", "WITH d AS (SELECT avg(close) AS c, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM bars GROUP BY day), b AS (SELECT r, j, CAST(concat('0x', substr(md5(concat_ws('|', 'mb', CAST(r AS STRING), CAST(j AS STRING))), 1, 12)) AS BIGINT) % (n - 4) AS s, n FROM (SELECT DISTINCT n FROM d), range(0, 2000) t(r), range(0, 100000) u(j) WHERE j * 5 < n), i AS (SELECT r, j * 5 + o AS place, s + o AS k, n FROM b, range(0, 5) v(o)), m AS (SELECT r, avg(c) AS m FROM i JOIN d USING (k) WHERE place < i.n GROUP BY 1) SELECT count(*) AS reps, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m")
def _(t):
    """Moving blocks of five days drawn with replacement, cut off at the series' length."""
    o = Window.partitionBy(F.lit(0))  # one row a day
    d = t.bars.groupBy("day").agg(F.avg("close").alias("c")).select("c", (F.row_number().over(o.orderBy("day")) - 1).alias("k"), F.count("*").over(o).alias("n"))
    starts = d.where("k % 5 = 0").select((F.col("k") / 5).cast("long").alias("j"), "n", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("r"))
    pick = F.conv(F.substring(hash_order("mb", F.col("r"), F.col("j")), 1, 12), 16, 10).cast("long") % (F.col("n") - 4)
    i = starts.withColumn("s", pick).select("r", "n", "j", "s", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("o")).where("j * 5 + o < n").select("r", (F.col("s") + F.col("o")).alias("k"))
    m = i.join(d.select("k", "c"), "k").groupBy("r").agg(F.avg("c").alias("m"))
    return m.agg(F.count("*").alias("reps"), F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi"))


# Features and the ranker
FEATURES = ["ret5", "ret10", "ret20", "ret60", "vol20", "vol60", "amihud", "turnover", "volvel", "accel", "maxdd", "rng", "above"]


def features(t):
    """The 13 causal price features, each known one bar before."""
    a = R.numbered(t.bars).join(t.meta.select(P, "reserve_usd"), P).withColumn("r", F.col("close") / F.lag("close").over(R.w()) - 1)
    c, v = F.col("close"), F.col("volume")
    made = {
        "ret5": R.roc(5), "ret10": R.roc(10), "ret20": R.roc(20), "ret60": R.roc(60), "vol20": rolling(F.stddev_samp, F.col("r"), R.w(), 20), "vol60": rolling(F.stddev_samp, F.col("r"), R.w(), 60),
        "amihud": 1e6 * rolling(F.avg, F.abs("r") / v, R.w(), 20), "turnover": R.sma("volume", 20) / F.col("reserve_usd"), "volvel": R.sma("volume", 5) / R.sma("volume", 20), "accel": R.roc(5) - R.roc(20) / 4,
        "maxdd": c / rolling(F.max, F.col("high"), R.w(), 20) - 1, "rng": rolling(F.avg, (F.col("high") - F.col("low")) / c, R.w(), 20), "above": c / R.sma("close", 20) - 1,
    }
    b = a.withColumns(made)
    return b.select(P, "day", "i", "close", *[F.lag(f).over(R.w()).alias(f) for f in FEATURES])


_F13 = f"""a AS (SELECT ib.*, m.reserve_usd, close / {_lag('close')} - 1 AS r FROM ib JOIN meta m USING (pair_address)), b AS (SELECT pair_address, i, close / {_lag('close', 5)} - 1 AS ret5, close / {_lag('close', 10)} - 1 AS ret10, close / {_lag('close', 20)} - 1 AS ret20, close / {_lag('close', 60)} - 1 AS ret60, {_n('stddev_samp', 'r', 20)} AS vol20, {_n('stddev_samp', 'r', 60)} AS vol60,
 1e6 * {_n('avg', 'abs(r) / volume', 20)} AS amihud, {_n('avg', 'volume', 20)} / reserve_usd AS turnover, {_n('avg', 'volume', 5)} / {_n('avg', 'volume', 20)} AS volvel, close / {_lag('close', 5)} - 1 - (close / {_lag('close', 20)} - 1) / 4 AS accel, close / {_n('max', 'high', 20)} - 1 AS maxdd, {_n('avg', '(high - low) / close', 20)} AS rng, close / {_n('avg', 'close', 20)} - 1 AS above FROM a)"""


@query("ml_features", f"WITH {_IB}, {_F13} SELECT pair_address, i, {', '.join(f'round({_lag(f)}, 6) AS {f}' for f in FEATURES)} FROM b")
def _(t):
    return rounded(features(t).select(P, "i", *FEATURES))


def ml_sample_of(t):
    """Names every seventh bar with the 13 features, the return of the next seven bars (clipped), its rank in the day as label, and one of three folds of the calendar; None without rows."""
    x = features(t).withColumn("y", F.lead("close", 7).over(R.w()) / F.col("close") - 1).where("i >= 60 and i % 7 = 0 and y is not null")
    day = Window.partitionBy("day")
    x = x.withColumns({"alive": F.count("*").over(day), "y": F.least(F.greatest("y", F.lit(-0.95)), F.lit(3.0))}).where("alive >= 3")
    x = materialised(x.withColumn("label", average_rank(F.col("y"), ["day"]) / F.count("*").over(day)))
    edges = x.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if edges.lo is None:
        return None
    return x.withColumn("fold", F.least(F.floor(F.datediff("day", F.lit(edges.lo)) * 3 / ((edges.hi - edges.lo).days + 1)), F.lit(2)).cast("int"))


def ml_models(x):
    """(fold, rows to score with medians filled in, model, assembler) of each fold but the first: boosted trees that learnt from all folds before it."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"{c}_f" for c in FEATURES]
    assembler = VectorAssembler(inputCols=filled, outputCol="features")
    for fold in (1, 2):
        train, test = x.where(F.col("fold") < fold), x.where(F.col("fold") == fold)
        if not train.isEmpty() and not test.isEmpty():
            imputer = Imputer(strategy="median", inputCols=FEATURES, outputCols=filled).fit(train)
            model = GBTRegressor(labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(assembler.transform(imputer.transform(train)))
            yield fold, imputer.transform(test), model, assembler


def ml_scored(t):
    """fold, day, pair, prediction, y out of sample; None without rows."""
    x, out = ml_sample_of(t), None
    for _, test, model, assembler in ml_models(x) if x is not None else ():
        s = model.transform(assembler.transform(test)).select("fold", "day", P, "prediction", "y")
        out = s if out is None else out.unionByName(s)
    return None if out is None else materialised(out)


@query("ml_walk_forward")
def _(t):
    """Boosted trees on the 13 features, expanding by calendar: each fold learns from all before it (their medians filled in, the return's daily rank as label), and its days are scored by rank correlation, top picks against the day's mean, and against 200 permutations of the labels."""
    s = ml_scored(t)
    if s is None:
        return t.spark.createDataFrame([], "fold int, days long, ic double, t double, edge double, win double, null_mean double, null_p95 double, p double")
    day = Window.partitionBy("fold", "day")
    ranked = s.withColumns({"pr": average_rank(F.col("prediction"), ["day"]), "yr": average_rank(F.col("y"), ["day"]), "top": F.row_number().over(day.orderBy(F.desc("prediction"), P))})
    d = ranked.groupBy("fold", "day").agg(correlation("pr", "yr").alias("ic"), (F.avg(F.when(F.col("top") <= 3, F.col("y"))) - F.avg("y")).alias("edge"), F.count("*").alias("n")).where("n >= 5 and ic is not null")
    told = d.groupBy("fold").agg(F.count("*").alias("days"), F.avg("ic").alias("ic"), (F.avg("ic") / F.nullif(F.stddev_pop("ic"), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"), F.avg("edge").alias("edge"), F.avg((F.col("ic") > 1e-9).cast("double")).alias("win"))
    null = K.permutation_distribution(s, ["fold"], "day", P, "prediction", "y")
    return told.join(null.select("fold", "null_mean", "null_p95", "p"), "fold", "left")


@query("ml_importances")
def _(t):
    """Of each feature: its share of the trees' gain, and how much of the mean rank correlation out of sample goes when its values change names within the day; mean over folds."""
    x, parts, gains = ml_sample_of(t), None, []
    for fold, test, model, assembler in ml_models(x) if x is not None else ():
        gains += [(fold, f, float(g)) for f, g in zip(FEATURES, model.featureImportances.toArray(), strict=True)]
        variants = K.with_each_shuffled(test.select("fold", "day", P, "y", *[f"{c}_f" for c in FEATURES]), [f"{c}_f" for c in FEATURES], "day", P)
        s = model.transform(assembler.transform(variants)).select("fold", "variant", "day", "prediction", "y")
        ic = K.mean_ic(s, ["fold", "variant"], "day", "prediction", "y")
        parts = ic if parts is None else parts.unionByName(ic)
    if parts is None:
        return t.spark.createDataFrame([], "feature string, gain double, ic double, ic_without double, drop double")
    parts = materialised(parts)
    whole = parts.where("variant = ''").select("fold", F.col("ic").alias("whole"))
    one = parts.where("variant <> ''").join(F.broadcast(whole), "fold").select("fold", F.regexp_replace("variant", "_f$", "").alias("feature"), "whole", "ic")  # a row a fold
    gain = t.spark.createDataFrame(gains, "fold int, feature string, gain double")
    g = one.join(gain, ["fold", "feature"]).groupBy("feature").agg(F.avg("gain").alias("gain"), F.avg("whole").alias("ic"), F.avg(F.col("ic")).alias("ic_without"))
    return rounded(g.withColumn("drop", F.col("ic") - F.col("ic_without")))


_RANKED = "rank() OVER (PARTITION BY d ORDER BY {0}) + (count(*) OVER (PARTITION BY d, {0}) - 1) / 2.0 - (count(*) OVER (PARTITION BY d) + 1) / 2.0"


@query("permutation_distribution", f"""WITH {_PANEL}, x AS MATERIALIZED (SELECT d, pair_address, {_RANKED.format('mom')} AS p, {_RANKED.format('fwd')} AS q, row_number() OVER (PARTITION BY d ORDER BY pair_address) AS a FROM g WHERE mom IS NOT NULL AND fwd IS NOT NULL),
dy AS MATERIALIZED (SELECT d, sqrt(sum(p * p) * sum(q * q)) AS norm, sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS ic FROM x GROUP BY d HAVING count(*) >= 5 AND round(sqrt(sum(p * p) * sum(q * q)), 9) > 0),
sh AS (SELECT x.d, seed, p, row_number() OVER (PARTITION BY x.d, seed ORDER BY md5(concat_ws('|', 'perm', CAST(seed AS STRING), CAST(x.d AS STRING), pair_address)), pair_address) AS a FROM x JOIN dy USING (d), range(0, 200) t(seed)),
nl AS (SELECT seed, avg(pq / norm) AS ic0 FROM (SELECT sh.d, seed, sum(sh.p * x.q) AS pq FROM sh JOIN x ON x.d = sh.d AND x.a = sh.a GROUP BY 1, 2) JOIN dy USING (d) GROUP BY 1), re AS (SELECT count(*) AS days, avg(ic) AS ic FROM dy)
SELECT days, round(ic, 6) AS ic, round(avg(ic0), 6) AS null_mean, round(stddev_pop(ic0), 6) AS null_sd, round(quantile_cont(ic0, 0.95), 6) AS null_p95, round((1 + count(*) FILTER (WHERE round(ic0, 9) >= round(ic, 9))) / 201.0, 6) AS p, round((ic - avg(ic0)) / stddev_pop(ic0), 4) AS z FROM nl, re GROUP BY days, ic""")
def _(t):
    """Mean daily rank correlation of past and next returns among 200 permutations."""
    x = K.permutation_distribution(panel(t), [], "d", P, "mom", "fwd")
    return x.select("days", *[F.round(c, 6).alias(c) for c in ("ic", "null_mean", "null_sd", "null_p95", "p")], F.round("z", 4).alias("z"))


# Portfolios
@query("window_sharpe", f"WITH {_IB}, {_RET}, d AS (SELECT day, avg(r) AS r, row_number() OVER (ORDER BY day) - 1 AS k FROM r WHERE r IS NOT NULL GROUP BY 1), s AS (SELECT step, k // 90 AS w, r - CASE WHEN k % step = 0 THEN 0.0151 ELSE 0 END AS r FROM d, (VALUES (1), (3), (7), (14)) v(step)) SELECT step, w, count(*) AS n, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(365), 4) AS sharpe FROM s GROUP BY 1, 2")
def _(t):
    """Sharpe ratio of each 90-day window of the basket by how often it is rebalanced."""
    o = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    d = daily_returns(t).groupBy("day").agg(F.avg("r").alias("r")).withColumn("k", F.row_number().over(o) - 1)
    s = d.withColumn("step", F.explode(F.array(*[F.lit(k) for k in (1, 3, 7, 14)]))).select("step", F.floor(F.col("k") / 90).alias("w"), (F.col("r") - F.when(F.col("k") % F.col("step") == 0, 0.0151).otherwise(0.0)).alias("r"))
    return s.groupBy("step", "w").agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg("r"), F.nullif(F.stddev_pop("r"), F.lit(0.0))) * F.sqrt(F.lit(365.0)), 4).alias("sharpe"))


@query("fee_tier_yield", "WITH y AS (SELECT p.fee_bps, b.pair_address, sum(b.volume) * p.fee_bps / 10000.0 / max(m.reserve_usd) AS yld FROM bars b JOIN meta m USING (pair_address) JOIN (SELECT pool AS pair_address, min(fee_bps) + max(id) % 3 * 5 AS fee_bps FROM pools GROUP BY 1) p USING (pair_address) GROUP BY p.fee_bps, b.pair_address) SELECT fee_bps, count(*) AS n, round(avg(yld), 6) AS mean, round(median(yld), 6) AS median FROM y GROUP BY 1")
def _(t):
    """Fee yield of liquidity by fee tier."""
    tier = t.pools.groupBy(F.col("pool").alias(P)).agg((F.min("fee_bps") + F.max("id") % 3 * 5).alias("fee_bps"))
    y = t.bars.groupBy(P).agg(F.sum("volume").alias("v")).join(t.meta.select(P, "reserve_usd"), P).join(tier, P)
    y = y.withColumn("yld", F.col("v") * F.col("fee_bps") / 10000.0 / F.col("reserve_usd"))
    return rounded(y.groupBy("fee_bps").agg(F.count("*").alias("n"), F.avg("yld").alias("mean"), F.median("yld").alias("median")))
