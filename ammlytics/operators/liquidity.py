"""Providing liquidity window by window: fees, divergence, gas, loss to arbitrage, over the full range or in a band; picks by in-sample yield against random ones.

Windows are 90 bars in sample and the next 45 out of sample, moving on by 45. Bars are summed once by blocks of 45: two blocks are a window's
sample, the third one is traded, so no bar is copied to several windows, and what is sequential (the band's centre) is a fold over one
block of 45 closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C
from ammlytics.functions.ordered import quantiles
from ammlytics.functions.rolling import hash_order

PAIR = "pair_address"
STEP = 45
BAND, VOLUME_CAP, SIZE_SHARE, LEAST_SIZE = 0.3, 3.0, 0.0025, 50.0


def windows(bars: DataFrame, meta: DataFrame) -> DataFrame:
    """pair, win, is_yield, reserve, fee, gas, s (bars of the traded block in order: i, close, volume) of the windows that fit, of pools with a reserve.

    bars(pair, i, close, volume), i from 0; meta(pair, reserve, fee, gas: fraction of a swap's volume and dollars a transaction).
    Pairs with a close that isn't positive have none.
    """
    sound = bars.groupBy(PAIR).agg(F.min(F.coalesce("close", F.lit(0.0))).alias("least")).where("least > 0").select(PAIR)
    b = bars.join(sound, PAIR).groupBy(PAIR, F.floor(F.col("i") / STEP).alias("b")).agg(F.sum("volume").alias("v"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "close", "volume"))).alias("s"))
    w = Window.partitionBy(PAIR).orderBy("b")  # a row a block
    x = b.withColumn("isv", F.lag("v", 2).over(w) + F.lag("v", 1).over(w)).where((F.col("b") >= 2) & (F.col("n") == STEP))
    x = x.join(meta.where("reserve > 0"), PAIR)
    return x.select(PAIR, (F.col("b") - 2).alias("win"), (F.col("isv") * F.col("fee") / F.col("reserve") / (2 * STEP)).alias("is_yield"), "reserve", "fee", "gas", "s")


def _moves(band: float) -> Column:
    """How often the band is centred anew: at each close outside centre / (1 + band) .. centre (1 + band)."""
    start = F.struct(F.col("s")[0]["close"].alias("mid"), F.lit(0).alias("moves"))

    def step(acc, x):
        out = (x["close"] < acc["mid"] / (1 + band)) | (x["close"] > acc["mid"] * (1 + band))
        return F.when(out, F.struct(x["close"].alias("mid"), (acc["moves"] + 1).alias("moves"))).otherwise(acc)

    return F.aggregate(F.slice("s", 2, STEP), start, step)["moves"]


def provided(wins: DataFrame, *, capped: bool = True, arbitraged: bool = True, band: float = BAND) -> DataFrame:
    """wins, a row for each mode (full, band): position, share, fees, il, gas_frac, lvr, net, apr as fractions of the position, moves, in_range (share of bars that didn't move the band).

    A position is a 400th of the reserve, 50 dollars at least. Fees are its share of volume (``capped`` at three times the reserve a
    bar); in a band they, divergence (no worse than everything) and the loss to arbitrage are multiplied by the band's concentration, and each new centre costs gas.
    """
    last = F.col("s")[STEP - 1]["close"]
    cap = f"least(coalesce(x.volume, 0D), {VOLUME_CAP}D * reserve)" if capped else "coalesce(x.volume, 0D)"
    sums = wins.withColumns(
        {
            "position": F.greatest(F.lit(LEAST_SIZE), SIZE_SHARE * F.col("reserve")),
            "vol": F.expr(f"aggregate(slice(s, 2, {STEP}), 0D, (a, x) -> a + {cap})"),
            "var": F.expr(f"aggregate(sequence(1, {STEP - 1}), 0D, (a, k) -> a + pow(ln(s[k].close / s[k - 1].close), 2D))"),
            "ratio": last / F.col("s")[0]["close"],
            "moves": _moves(band),
        }
    )
    share = F.col("position") / (F.col("reserve") + F.col("position"))
    boost = F.when(F.col("mode") == "band", C.concentration(F.lit(band))).otherwise(1.0)
    il = C.impermanent_loss(F.col("ratio"))
    x = sums.withColumn("mode", F.explode(F.array(F.lit("full"), F.lit("band")))).withColumns({"share": share, "boost": boost, "moves": F.when(F.col("mode") == "band", F.col("moves")).otherwise(0)})
    x = x.withColumns(
        {
            "fees": F.col("vol") * F.col("fee") * F.col("share") * F.col("boost") / F.col("position"),
            "il": F.when(F.col("mode") == "band", F.least(F.greatest(il * F.col("boost"), F.lit(-1.0)), F.lit(0.0))).otherwise(il),
            "gas_frac": -(2 + F.col("moves")) * F.col("gas") / F.col("position"),
            "lvr": -0.125 * F.col("var") * F.col("boost") if arbitraged else F.lit(0.0),
            "in_range": 1 - F.col("moves") / (STEP - 1.0),
        }
    )
    net = F.col("fees") + F.col("il") + F.col("gas_frac") + F.col("lvr")
    return x.select(PAIR, "win", "mode", "is_yield", "position", "share", "fees", "il", "gas_frac", "lvr", net.alias("net"), (net * 365.0 / STEP).alias("apr"), "moves", "in_range")


def selection(rows: DataFrame, keys: list[str], *, top: int = 5, seeds: int = 300) -> DataFrame:
    """By keys: apr of all windows (median, mean, share above 0), of the ``top`` of each window by in-sample yield, and of as many random ones, ``seeds`` times a window: null_mean, null_sd, z, p.

    Windows with fewer than top + 2 pools are left out of picks. rows: ``provided`` with the columns in keys. The random picks of a window are
    the same for all keys.
    """
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("apr").alias("apr_mean"), F.avg((F.col("apr") > 0).cast("double")).alias("positive")).join(quantiles(rows, keys, "apr", {"apr_median": 0.5}), keys)
    large = rows.groupBy(*keys, "win").agg(F.count("*").alias("pools")).where(F.col("pools") >= top + 2).select(*keys, "win")
    x = rows.join(large, [*keys, "win"])
    best = x.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "win").orderBy(F.desc(F.round("is_yield", 12)), PAIR))).where(F.col("r") <= top)
    real = best.groupBy(*keys).agg(F.avg("apr").alias("picked_mean"), F.avg((F.col("apr") > 0).cast("double")).alias("picked_positive")).join(quantiles(best, keys, "apr", {"picked_median": 0.5}), keys)
    pools = x.select("win", PAIR).distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    drawn = pools.withColumn("r", F.row_number().over(Window.partitionBy("win", "seed").orderBy(hash_order("lp", F.col("seed"), F.col("win"), F.col(PAIR)), PAIR))).where(F.col("r") <= top).select("win", PAIR, "seed")
    null = x.join(drawn, ["win", PAIR]).groupBy(*keys, "win", "seed").agg(F.avg("apr").alias("m"))
    p = null.join(real.select(*keys, "picked_mean"), keys).groupBy(*keys).agg(F.avg("m").alias("null_mean"), F.stddev_pop("m").alias("null_sd"), F.avg((F.round("m", 9) >= F.round("picked_mean", 9)).cast("double")).alias("p"))
    z = (F.col("picked_mean") - F.col("null_mean")) / (F.col("null_sd") + 1e-12)
    return whole.join(real, keys).join(p, keys).withColumn("z", z)
