"""Signals, trade simulation, walk-forward evaluation, nulls, cross-sectional selection, portfolios: research over price bars.

Bars are long tables (pair_address, i, open, high, low, close, volume) with i = 0, 1, ... in order of time. Nothing is pivoted, and what
is sequential (holding one position at a time) is a fold over each pair's ordered array inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions.columns import profit_factor
from ammlytics.functions.ordered import running
from ammlytics.functions.rolling import ema, hash_order, rolling
from ammlytics.operators.correlation import participation
from ammlytics.session import materialised

PAIR = "pair_address"


def w(*keys: str):
    return Window.partitionBy(*(keys or (PAIR,))).orderBy("i")


def numbered(bars: DataFrame, by: str = "day", keys: tuple[str, ...] = (PAIR,)) -> DataFrame:
    """Adds i, the place of a bar in its pair."""
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(by)) - 1)


def folds(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with fold, 0 to n - 1: as many rows of the given order in each, but for one."""
    whole = rows.agg(F.count("*").alias("_n"))
    x = running(rows, [], order, {"_k": F.lit(1)}).join(F.broadcast(whole))  # one row
    return x.withColumn("fold", F.floor((F.col("_k") - 1) * n / F.col("_n"))).drop("_k", "_n")


def shifted(cond: Column) -> Column:
    """A condition known one bar later; false on the first bar and where it is unknown."""
    return F.coalesce(F.lag(cond).over(w()), F.lit(False))


def with_indicators(b: DataFrame, **wanted: Column) -> DataFrame:
    return b.withColumns(wanted)


def _prev() -> Column:
    return F.lag("close").over(w())


def base_columns(b: DataFrame) -> DataFrame:
    """chg (0 at first), previous close (the last one at first, as a rolled array has it) and true range."""
    first_prev = F.coalesce(_prev(), F.col("close"))
    return b.withColumns(
        {
            "chg": F.col("close") - first_prev,
            "prev": F.coalesce(_prev(), F.last("close").over(w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
            "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - first_prev), F.abs(F.col("low") - first_prev)),
        }
    )


def sma(x: str, n: int) -> Column:
    return rolling(F.avg, F.col(x), w(), n)


def rsi(n: int) -> Column:
    """Needs ``chg``; null where the mean loss isn't positive."""
    up = rolling(F.avg, F.greatest(F.col("chg"), F.lit(0.0)), w(), n)
    down = rolling(F.avg, F.greatest(-F.col("chg"), F.lit(0.0)), w(), n)
    return F.when(down > 0, 100 - 100 / (1 + up / down))


def atr(n: int) -> Column:
    return rolling(F.avg, F.col("tr"), w(), n)


def roc(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(w()) - 1


def _band(n: int, k: float) -> Column:
    return sma("close", n) + k * rolling(F.stddev_samp, F.col("close"), w(), n)


def _run(up: bool, n: int) -> Column:
    hit = F.when((F.col("chg") > 0) if up else (F.col("chg") < 0), 1).otherwise(0)
    return rolling(F.sum, hit, w(), n) >= n


#: Entry condition of each family on a frame of base_columns, before the shift; parameters as in the defaults of FAMILY_PARAMS.
FAMILIES = {
    "sma_cross": lambda f, s: sma("close", f) > sma("close", s),
    "price_above_ma": lambda n: F.col("close") > sma("close", n),
    "donchian_bo": lambda n: F.col("close") >= rolling(F.max, F.col("high"), w(), n),
    "donchian_rev": lambda n: F.col("close") <= rolling(F.min, F.col("low"), w(), n),
    "rsi_os": lambda n, thr: rsi(n) < thr,
    "rsi_mom": lambda n, thr: rsi(n) > thr,
    "boll_rev": lambda n, k: F.col("close") < _band(n, -k),
    "boll_bo": lambda n, k: F.col("close") > _band(n, k),
    "atr_bo": lambda n, k: F.col("close") > F.col("prev") + k * atr(n),
    "roc_mom": lambda n, thr: roc(n) > thr,
    "roc_rev": lambda n, thr: roc(n) < -thr,
    "vol_bo": lambda n, k: (F.col("volume") > k * sma("volume", n)) & (F.col("close") > F.col("prev")),
    "consec_down": lambda n: _run(False, n),
    "consec_up": lambda n: _run(True, n),
}
FAMILY_PARAMS = {
    "sma_cross": (5, 20),
    "ema_cross": (5, 21),
    "price_above_ma": (20,),
    "donchian_bo": (20,),
    "donchian_rev": (20,),
    "rsi_os": (14, 30.0),
    "rsi_mom": (14, 60.0),
    "boll_rev": (20, 1.5),
    "boll_bo": (20, 1.5),
    "atr_bo": (14, 1.0),
    "roc_mom": (5, 0.1),
    "roc_rev": (5, 0.1),
    "vol_bo": (20, 2.0),
    "consec_down": (3,),
    "consec_up": (3,),
    "ma_pullback": (20,),
}


def signal(b: DataFrame, family: str, *params) -> DataFrame:
    """b(pair_address, i, ...) of base_columns with the boolean ``entry`` of a family, known at its bar."""
    params = params or FAMILY_PARAMS[family]
    if family == "ema_cross":
        fast, slow = (ema(b.select(PAIR, "i", "close"), [PAIR], "i", "close", n, f"e{n}").drop("close") for n in params)
        x = b.join(fast, [PAIR, "i"]).join(slow, [PAIR, "i"])
        return x.withColumn("entry", shifted(F.col(f"e{params[0]}") > F.col(f"e{params[1]}"))).drop(f"e{params[0]}", f"e{params[1]}")
    if family == "ma_pullback":
        x = b.withColumn("ma", sma("close", params[0]))
        rising = F.col("ma") > F.lag("ma", 3).over(w())
        return x.withColumn("entry", shifted(rising & (F.col("close") < F.col("ma")) & (F.col("close") > F.col("prev")))).drop("ma")
    return b.withColumn("raw", FAMILIES[family](*params)).withColumn("entry", shifted(F.col("raw"))).drop("raw")


# Simulation -------------------------------------------------------------------------------------------------------------------


def _trades(a: DataFrame, keys: list[str], tp: str, sl: str, hold: str, entry: str, rule: str, gap: int) -> DataFrame:
    """Trades of arrays as long as a window: a(keys, s: ordered bars, n) with target, stop and hold as SQL (literals or columns) and the entry condition of bar s[k]."""
    # candidate exits: position in the array, not bar number, so that slices of a series work as well
    hit_expr = f"""transform(sequence(0, n - 1), k -> if({entry} and s[k].close > 0 and k < n - 1,
        struct(k as k, array_min(filter(sequence(k + 1, least(k + {hold}, n - 1)), j -> s[j].low <= s[k].close * (1D - {sl}) or s[j].high >= s[k].close * (1D + {tp}))) as hit), null))"""
    x = a.withColumn("c", F.expr(f"filter({hit_expr}, e -> e is not null)"))
    fold = F.expr(f"""aggregate(c, struct(0 as free, cast(array() as array<struct<k: int, hit: int>>) as kept),
        (acc, e) -> if(e.k < acc.free, acc, struct(if(e.hit is null, least(e.k + {hold}, n - 1) + {gap}, e.hit + 1) as free, array_append(acc.kept, e) as kept))).kept""")
    return _priced(x.withColumn("e", F.explode(fold)), keys, tp, sl, hold, rule)


def _priced(x: DataFrame, keys: list[str], tp: str, sl: str, hold: str, rule: str) -> DataFrame:
    """Trades of the entries e (place k, place of the bar that ends it or null) in arrays s."""
    t = x.withColumns({"a": F.expr("s[e.k]"), "z": F.expr(f"s[coalesce(e.hit, least(e.k + {hold}, n - 1))]")})
    stop = F.expr(f"e.hit is not null and z.low <= a.close * (1D - {sl})")
    target = F.expr(f"e.hit is not null and z.high >= a.close * (1D + {tp})")
    both = F.expr({"sl_first": f"-{sl}", "tp_first": tp, "split": f"({tp} - {sl}) / 2"}[rule])
    ret = F.when(stop & target, both).when(stop, F.expr(f"-{sl}")).when(target, F.expr(tp)).otherwise(F.expr("z.close / a.close - 1"))
    how = F.when(stop & target, "both").when(stop, "sl").when(target, "tp").otherwise("time")
    return t.select(*keys, F.col("a.i").alias("i"), F.col("z.i").alias("j"), ret.cast("double").alias("ret"), how.alias("how"))


#: Bars of a block of a long series, at least.
BLOCK = 512


def _blocks(b: DataFrame, keys: list[str], columns: list[str], hold: int) -> DataFrame:
    """keys, _b (block), s (its bars in order, and ``hold`` bars of the next one to look ahead), own (bars that are its own), n (bars from its first one to the series' end)."""
    size = max(BLOCK, hold)
    block = F.floor(F.col("i") / size).cast("int")
    there = F.when(F.col("i") % size < hold, F.array(block, block - 1)).otherwise(F.array(block))
    ends = b.groupBy(*keys).agg(F.max("i").alias("_last"))
    x = b.select(*keys, "i", *columns, F.explode(there).alias("_b"))
    a = x.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("s"))
    a = a.withColumn("own", F.size(F.filter("s", lambda r: r["i"] < (F.col("_b") + 1) * size))).where("own > 0")
    return a.join(ends, keys).withColumn("n", (F.col("_last") - F.col("s")[0]["i"] + 1).cast("int")).drop("_last")


def _one_at_a_time(a: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """a(keys, _b, s, own, n, c: candidate entries in order with place k and the place ``free`` from which on the next one may follow) with a row for each entry e that is taken when one follows another.

    A block turns the place at which it is entered (0 to ``reach``) into the place at which the next one is: a map of few numbers, found from
    its end. Mostly all places lead to the same one, so maps are composed in runs that start at such a block; then each block picks
    its entries by itself. A series of any length is many groups and no array is longer than a block.
    """
    first_from = "get(filter({0}, y -> y.k >= {1}), 0).x"
    exits = f"""aggregate(reverse(c), cast(array() as array<struct<k: int, x: int>>),
        (acc, e) -> concat(array(struct(e.k as k, if(e.free >= own, e.free - own, coalesce({first_from.format('acc', 'e.free')}, 0)) as x)), acc))"""
    a = materialised(a)  # read for the maps and for the entries
    # the array of one binds x: as a column it would be computed again for each place
    each = f"transform(array({exits}), x -> transform(sequence(0, {reach}), o -> coalesce({first_from.format('x', 'o')}, greatest(o - own, 0))))[0]"
    m = a.select(*keys, "_b", F.expr(each).alias("m"))
    order = Window.partitionBy(*keys).orderBy("_b")
    runs = m.withColumn("run", F.sum(F.when(F.array_min("m") == F.array_max("m"), 1).otherwise(0)).over(order))
    composed = """aggregate(array_sort(collect_list(struct(_b, m))), struct(cast(null as int) as at, cast(array() as array<struct<_b: int, out: int>>) as ends),
        (acc, x) -> struct(x.m[coalesce(acc.at, 0)] as at, array_append(acc.ends, struct(x._b as _b, x.m[coalesce(acc.at, 0)] as out)) as ends)).ends"""
    ends = runs.groupBy(*keys, "run").agg(F.expr(composed).alias("ends")).select(*keys, F.inline("ends"))
    entered = ends.select(*keys, "_b", F.coalesce(F.lag("out").over(order), F.lit(0)).alias("_at"))
    fold = F.expr("aggregate(c, struct(_at as free, slice(c, 1, 0) as kept), (acc, e) -> if(e.k < acc.free, acc, struct(e.free as free, array_append(acc.kept, e) as kept))).kept")
    return a.join(entered, [*keys, "_b"]).withColumn("e", F.explode(fold))


def simulate(b: DataFrame, tp: float, sl: float, hold: int, *, keys: tuple[str, ...] = (PAIR,), rule: str = "sl_first", time_exit_gap: bool = True) -> DataFrame:
    """Long trades, one position at a time: keys, i (entry), j (exit bar), ret before cost, how. i counts a series' bars without gaps.

    From the bar after entry the stop (low <= price (1 - sl)) or the target (high >= price (1 + tp)) ends a trade at exactly -sl or tp;
    a bar that spans both counts by ``rule`` (sl_first, tp_first, split). Else it ends at the close ``hold`` bars on or at the last bar. The
    next entry is looked for from the exit on: one bar on, after a time exit two if ``time_exit_gap``.
    """
    gap = 2 if time_exit_gap else 1
    a = _blocks(b, list(keys), ["entry", "high", "low", "close"], hold)
    hit = f"array_min(filter(sequence(k + 1, least(k + {hold}, n - 1)), j -> s[j].low <= s[k].close * (1D - {sl!r}D) or s[j].high >= s[k].close * (1D + {tp!r}D)))"
    some = f"transform(filter(sequence(0, own - 1), k -> s[k].entry and s[k].close > 0 and k < n - 1), k -> struct(k as k, {hit} as hit))"
    c = F.expr(f"transform({some}, e -> struct(e.k as k, e.hit as hit, if(e.hit is null, least(e.k + {hold}, n - 1) + {gap}, e.hit + 1) as free))")
    return _priced(_one_at_a_time(a.withColumn("c", c), list(keys), hold + gap), list(keys), f"{tp!r}D", f"{sl!r}D", str(hold), rule)


def simulate_close_stop(b: DataFrame, stop: float, hold: int, keys: tuple[str, ...] = (PAIR,)) -> DataFrame:
    """Long trades from close to close: the first close at or below price (1 - stop) ends a trade there, else the close ``hold`` bars on or the last; the next entry from the bar after."""
    a = _blocks(b, list(keys), ["entry", "close"], hold)
    end = f"coalesce(array_min(filter(sequence(k + 1, least(k + {hold}, n - 1)), j -> s[j].close <= s[k].close * (1D - {stop!r}D))), least(k + {hold}, n - 1))"
    some = f"transform(filter(sequence(0, own - 1), k -> s[k].entry and s[k].close > 0 and k < n - 1), k -> struct(k as k, {end} as z))"
    t = _one_at_a_time(a.withColumn("c", F.expr(f"transform({some}, e -> struct(e.k as k, e.z as z, e.z + 1 as free))")), list(keys), hold + 1)
    return _held(t, list(keys))


def close_to_close(b: DataFrame, hold: int, keys: tuple[str, ...] = (PAIR,)) -> DataFrame:
    """Fixed holding from close to close; next entry from the bar after the exit."""
    a = _blocks(b, list(keys), ["entry", "close"], hold)
    some = f"transform(filter(sequence(0, own - 1), k -> s[k].entry and k < n - 1), k -> struct(k as k, least(k + {hold}, n - 1) as z, least(k + {hold}, n - 1) + 1 as free))"
    return _held(_one_at_a_time(a.withColumn("c", F.expr(some)), list(keys), hold + 1), list(keys))


def _held(t: DataFrame, keys: list[str]) -> DataFrame:
    t = t.select(*keys, F.expr("s[e.k]").alias("a"), F.expr("s[e.z]").alias("z"))
    return t.select(*keys, F.col("a.i").alias("i"), F.col("z.i").alias("j"), (F.col("z.close") / F.col("a.close") - 1).alias("ret"))


def score(trades: DataFrame, keys: list[str], cost: Column | float = 0.0) -> DataFrame:
    """Number, net sum, mean, profit factor of net returns by keys."""
    net = F.col("ret") - cost
    gains, losses = F.sum(F.when(net > 0, net).otherwise(0.0)), F.sum(F.when(net < 0, net).otherwise(0.0))
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(net).alias("net"), F.avg(net).alias("avg_trade"), profit_factor(gains, losses).alias("pf"))


def penalised(pf: Column, n: Column) -> Column:
    """Profit factor drawn to 1 for few trades: 1 + n / (n + 10) (min(pf, 10) - 1)."""
    return 1 + n / (n + 10) * (F.least(pf, F.lit(10.0)) - 1)


def windows(b: DataFrame, is_len: int, oos_len: int) -> DataFrame:
    """(pair, window start) of all walk-forward windows that fit: starts 0, oos_len, 2 oos_len, ..."""
    n = b.groupBy(PAIR).agg(F.count("*").alias("n")).where(F.col("n") >= is_len + oos_len)
    return n.select(PAIR, F.explode(F.sequence(F.lit(0), (F.col("n") - is_len - oos_len).cast("int"), F.lit(oos_len))).alias("start"))


def with_signals(b: DataFrame, signals: dict[str, tuple]) -> DataFrame:
    """b of base_columns with ``entries``: a boolean for each family, in order."""
    plain = [f for f in signals if f in FAMILIES]
    x = b.withColumns({f"_raw_{f}": FAMILIES[f](*signals[f]) for f in plain})
    x = x.withColumns({f"_in_{f}": shifted(F.col(f"_raw_{f}")) for f in plain})
    for f in signals:
        if f not in FAMILIES:
            x = signal(x, f, *signals[f]).withColumnRenamed("entry", f"_in_{f}")
    return x.withColumn("entries", F.array(*[F.col(f"_in_{f}") for f in signals])).drop(*[f"_raw_{f}" for f in signals], *[f"_in_{f}" for f in signals])


def window_trades(b: DataFrame, signals: dict[str, tuple], brackets: list[tuple[float, float, int]], *, is_len: int, oos_len: int) -> DataFrame:
    """Trades (pair, start, part, family, draw, i, j, ret, how) of every family and bracket in the in-sample and out-of-sample part of every walk-forward window.

    A window's bars are one array, made once and shared by all families and brackets.
    """
    x = with_signals(b, signals).select(PAIR, "i", "high", "low", "close", "entries").join(windows(b, is_len, oos_len), PAIR)
    cut = F.col("i") - F.col("start")
    x = x.where(cut.between(0, is_len + oos_len - 1)).withColumn("part", F.when(cut < is_len, "is").otherwise("oos"))
    a = x.groupBy(PAIR, "start", "part").agg(F.array_sort(F.collect_list(F.struct("i", "high", "low", "close", "entries"))).alias("s")).withColumn("n", F.size("s"))
    grid = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("f"), F.lit(d).alias("draw"), F.lit(float(tp)).alias("tp"), F.lit(float(sl)).alias("sl"), F.lit(hold).alias("hold")) for n, f in enumerate(signals) for d, (tp, sl, hold) in enumerate(brackets)]
    a = a.withColumn("g", F.explode(F.array(*grid))).select("*", "g.family", "g.f", "g.draw", "g.tp", "g.sl", "g.hold").drop("g")
    return _trades(a, [PAIR, "start", "part", "family", "draw"], "tp", "sl", "hold", "s[k].entries[f]", "sl_first", 2)


def best_in_sample(trades: DataFrame, cost: float, least_is: int, most_draws: int | None = None) -> DataFrame:
    """Of each pair, family and window the draw with the best profit factor in sample (to nine digits), the first of equal ones; only the first ``most_draws``."""
    rows = trades.where("part = 'is'") if most_draws is None else trades.where((F.col("part") == "is") & (F.col("draw") < most_draws))
    ranked = score(rows, [PAIR, "family", "start", "draw"], cost).where(F.col("n") >= least_is)
    return ranked.withColumn("r", F.row_number().over(Window.partitionBy(PAIR, "family", "start").orderBy(F.desc(F.round("pf", 9)), "draw"))).where("r = 1").select(PAIR, "family", "start", "draw")


def walk_forward(b: DataFrame, signals: dict[str, tuple], brackets: list[tuple[float, float, int]], *, is_len: int, oos_len: int, least_is: int = 5, least_oos: int = 4, cost: float = 0.0) -> DataFrame:
    """Of each pair and family: the bracket that is best in sample (profit factor, first of equal ones) is traded out of sample; pooled.

    Signals use the whole series, trades stay in their window. b: frame of base_columns. cost: a round trip's fraction.
    """
    trades = window_trades(b, signals, brackets, is_len=is_len, oos_len=oos_len)
    best = best_in_sample(trades, cost, least_is)
    out = score(trades.where("part = 'oos'").join(best, [PAIR, "family", "start", "draw"]), [PAIR, "family"], cost).where(F.col("n") >= least_oos)
    return out.withColumn("pass", (F.round("pf", 9) > 1) & (F.round("net", 9) > 0))


def noise_sweep(b: DataFrame, null: DataFrame, signals: dict[str, tuple], brackets: list[tuple[float, float, int]], draws: list[int], *, is_len: int, oos_len: int, least_is: int = 5, cost: float = 0.0) -> DataFrame:
    """What picking the best of ever more draws in sample gives in and out of sample, for the bars and for a null of them: (series, draws, windows, is_net, oos_net, oos_n)."""
    out = None
    for name, frame in (("real", b), ("null", null)):
        trades = window_trades(frame, signals, brackets, is_len=is_len, oos_len=oos_len)
        for n in draws:
            chosen = trades.join(best_in_sample(trades, cost, least_is, n), [PAIR, "family", "start", "draw"])
            net = F.col("ret") - cost
            part = lambda p, x: F.coalesce(F.sum(F.when(F.col("part") == p, x)), F.lit(0.0))
            one = chosen.agg(F.count_distinct(PAIR, "family", "start").alias("windows"), part("is", net).alias("is_net"), part("oos", net).alias("oos_net"), F.count_if(F.col("part") == "oos").alias("oos_n"))
            one = one.select(F.lit(name).alias("series"), F.lit(n).alias("draws"), "windows", "is_net", "oos_net", "oos_n")
            out = one if out is None else out.unionByName(one)
    return out


def archetype(b: DataFrame, name: str, n: int, threshold: float) -> DataFrame:
    """b(pair, i, close, volume) with the boolean entry of an archetype; everything is known one bar before: momentum, breakout, reversion, volsurge."""
    x = b.withColumns({"c1": F.lag("close").over(w()), "v1": F.lag(F.coalesce("volume", F.lit(0.0))).over(w())})
    if name == "momentum":
        hit = F.col("c1") / F.lag("c1", n).over(w()) - 1 > threshold
    elif name == "breakout":
        hit = F.col("c1") >= rolling(F.max, F.col("c1"), w(), n)
    elif name == "reversion":
        hit = F.try_divide(F.col("c1") - rolling(F.avg, F.col("c1"), w(), n), F.nullif(rolling(F.stddev_samp, F.col("c1"), w(), n), F.lit(0.0))) < -threshold
    elif name == "volsurge":
        hit = (F.col("v1") > threshold * rolling(F.avg, F.col("v1"), w(), n)) & (F.col("c1") / F.lag("c1").over(w()) - 1 > 0)
    else:
        raise ValueError(name)
    return x.withColumn("entry", F.coalesce(hit, F.lit(False))).drop("c1", "v1")


# Nulls ------------------------------------------------------------------------------------------------------------------------


def shuffled(b: DataFrame, seed: str, by: list[str], values: list[str], place: str = "i") -> DataFrame:
    """Rows of each group keep their places and get each other's values together, in an order set by a hash of seed, key and place."""
    key = hash_order(seed, *[F.col(c) for c in (*by, place)])
    x = b.withColumns({"_a": F.row_number().over(Window.partitionBy(*by).orderBy(place)), "_b": F.row_number().over(Window.partitionBy(*by).orderBy(key, place))})
    keep = x.select(*[c for c in b.columns if c not in values], "_a")
    given = x.select(*by, F.col("_b").alias("_a"), *values)
    return keep.join(given, [*by, "_a"]).drop("_a")


def p_value(real: Column, null: Column, n: Column) -> Column:
    """(1 + nulls at least as large) / (n + 1)."""
    return (1 + F.coalesce(F.sum((null >= real).cast("int")), F.lit(0))) / (n + 1)


# Cross-section ----------------------------------------------------------------------------------------------------------------


def top_k(panel: DataFrame, date: str, feature: Column, k: int, *, descending: bool = True, least: int | None = None) -> DataFrame:
    """The k rows of each date with the largest feature (ties by pair), on dates with at least ``least`` of them."""
    order = feature.desc() if descending else feature.asc()
    x = panel.where(feature.isNotNull()).withColumns({"_n": F.count("*").over(Window.partitionBy(date)), "_r": F.row_number().over(Window.partitionBy(date).orderBy(order, PAIR))})
    return x.where((F.col("_r") <= k) & (F.col("_n") >= (least or 2 * k))).drop("_n", "_r")


def participation_ratio(returns: DataFrame, stream: str, date: str, value: str, least: int = 3) -> DataFrame:
    """n^2 / sum of squared correlations of the streams, with the median absolute correlation; missing days count as 0. One row."""
    found = participation(returns, stream, date, value, least)
    return returns.sparkSession.createDataFrame([found], "n long, participation double, median_abs_corr double")


def metrics(daily: DataFrame, keys: list[str], date: str, value: str, *, geometric: bool, year: float = 365.0) -> DataFrame:
    """Yearly return and volatility, Sharpe ratio, largest drawdown, Calmar ratio of daily returns (all > -1)."""
    o = Window.partitionBy(*keys).orderBy(date)
    curve = F.exp(F.sum(F.log1p(value)).over(o)) if geometric else F.sum(value).over(o)
    x = daily.withColumn("_e", curve)
    peak = F.max("_e").over(o.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_d", F.col("_e") / peak - 1 if geometric else F.col("_e") - peak)
    n = F.count("*")
    ret = F.exp(F.sum(F.log1p(value)) * year / n) - 1 if geometric else F.avg(value) * year
    vol = F.stddev_samp(value) * F.sqrt(F.lit(year))
    out = x.groupBy(*keys).agg(n.alias("n"), ret.alias("ann_ret"), vol.alias("ann_vol"), (F.avg(value) * year).alias("_m"), F.min("_d").alias("max_dd"))
    return out.select(*keys, "n", "ann_ret", "ann_vol", F.try_divide("_m", F.nullif("ann_vol", F.lit(0.0))).alias("sharpe"), "max_dd", F.try_divide("ann_ret", F.nullif(-F.col("max_dd"), F.lit(0.0))).alias("calmar"))
