"""A grid of archetypes, holdings and stops over all pairs in one pass: trades one at a time for each combination, pair and part of the calendar.

Signals of all settings are columns of one frame and exits of all brackets are found once a bar; a combination only picks its signal and
its bracket. Blocks of bars are read once, what is multiplied by the combinations are their candidates (places and returns), not bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.functions.columns import profit_factor
from ammlytics.functions.rolling import rolling
from ammlytics.operators import research as R

PAIR = R.PAIR
#: Lengths and thresholds of each archetype, holdings, stops.
GRID = {
    "momentum": [(n, t) for n in (3, 5, 10, 20) for t in (0.05, 0.15, 0.30)],
    "breakout": [(n, 0.0) for n in (5, 10, 20, 30)],
    "reversion": [(n, t) for n in (5, 10, 20) for t in (1.0, 1.5, 2.0)],
    "volsurge": [(n, t) for n in (5, 10, 20) for t in (2.0, 3.0, 5.0)],
}
HOLDS, STOPS = (3, 7, 14), (0.15, 0.30)
SETTINGS = [(a, n, t) for a, grid in GRID.items() for n, t in grid]
BRACKETS = [(hold, stop) for hold in HOLDS for stop in STOPS]


def names() -> list[tuple[str, int, int]]:
    """Name, number of the signal and number of the bracket of each combination."""
    return [(f"{a}_L{n}_t{t:g}_h{hold}_s{stop:g}", g, k) for g, (a, n, t) in enumerate(SETTINGS) for k, (hold, stop) in enumerate(BRACKETS)]


def with_settings(b: DataFrame) -> DataFrame:
    """b(pair, i, close, volume) with ``sigs``, the entry condition of every setting, known one bar before; false where it is unknown."""
    w = R.w()
    x = b.withColumns({"c1": F.lag("close").over(w), "v1": F.lag(F.coalesce("volume", F.lit(0.0))).over(w)})
    rise = F.col("c1") / F.lag("c1").over(w) - 1 > 0

    def hit(a: str, n: int, t: float):
        if a == "momentum":
            return F.col("c1") / F.lag("c1", n).over(w) - 1 > t
        if a == "breakout":
            return F.col("c1") >= rolling(F.max, F.col("c1"), w, n)
        if a == "reversion":
            return F.try_divide(F.col("c1") - rolling(F.avg, F.col("c1"), w, n), F.nullif(rolling(F.stddev_samp, F.col("c1"), w, n), F.lit(0.0))) < -t
        return (F.col("v1") > t * rolling(F.avg, F.col("v1"), w, n)) & rise

    return x.withColumn("sigs", F.array(*[F.coalesce(hit(*s), F.lit(False)) for s in SETTINGS])).drop("c1", "v1")


def trades(b: DataFrame) -> DataFrame:
    """combo, pair, part, ret of the trades of all combinations; b(pair, i, close, sigs, part: true in sample). A signal enters only in its part, exits may lie beyond."""
    most = max(HOLDS)
    a = R._blocks(b, [PAIR], ["close", "sigs", "part"], most)
    for k, (hold, stop) in enumerate(BRACKETS):
        end = f"coalesce(array_min(filter(sequence(k + 1, least(k + {hold}, n - 1)), j -> s[j].close <= s[k].close * (1D - {stop!r}D))), least(k + {hold}, n - 1))"
        a = a.withColumn(f"z{k}", F.expr(f"transform(sequence(0, own - 1), k -> if(k < n - 1, {end}, k))"))
    a = R.materialised(a.withColumn("z", F.array(*[f"z{k}" for k in range(len(BRACKETS))])).select(PAIR, "_b", "s", "own", "n", "z"))
    table = F.array(*[F.struct(F.lit(name).alias("combo"), F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(part).alias("part")) for name, g, k in names() for part in (True, False)])
    picked = """transform(combos, m -> struct(m.combo as combo, m.part as part,
        transform(filter(sequence(0, own - 1), k -> s[k].sigs[m.g] and s[k].part = m.part and s[k].close > 0 and k < n - 1), k -> struct(k as k, z[m.k][k] + 1 as free, s[z[m.k][k]].close / s[k].close - 1 as ret)) as c))"""
    spread = a.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), PAIR, "_b")  # blocks are small, what is made of one isn't
    c = spread.withColumn("combos", table).select(PAIR, "_b", "own", F.explode(F.expr(picked)).alias("x")).select(PAIR, "_b", "own", "x.combo", "x.part", "x.c").where("size(c) > 0")
    c = R.materialised(c)
    return R._one_at_a_time(_whole(c, a), [PAIR, "combo", "part"], most + 1).select("combo", PAIR, "part", F.col("e.ret").alias("ret"))


def _whole(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks without a candidate of a combination turn every place into what is left of it: those that follow one with candidates are added."""
    used = rows.select(PAIR, "combo", "part").distinct()
    every = used.join(blocks.select(PAIR, "_b", "own"), PAIR)
    empty = every.join(rows.select(PAIR, "_b", "combo", "part"), [PAIR, "_b", "combo", "part"], "left_anti")
    none = F.expr("cast(array() as array<struct<k: int, free: int, ret: double>>)")
    return rows.unionByName(empty.withColumn("c", none))


def scored(tape: DataFrame, keys: list[str], cost: DataFrame) -> DataFrame:
    """keys, is_n, oos_n, is_pf, oos_pf, oos_net of trades net of each pair's cost(pair, cost)."""
    x = tape.join(cost, PAIR).withColumn("net", F.col("ret") - F.col("cost"))

    def side(part: bool, v) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, v)), F.lit(0.0))

    def pf(part: bool) -> F.Column:
        return profit_factor(side(part, F.greatest("net", F.lit(0.0))), side(part, F.least("net", F.lit(0.0))))

    return x.groupBy(*keys).agg(F.count_if("part").alias("is_n"), F.count_if(~F.col("part")).alias("oos_n"), pf(True).alias("is_pf"), pf(False).alias("oos_pf"), side(False, F.col("net")).alias("oos_net"))
