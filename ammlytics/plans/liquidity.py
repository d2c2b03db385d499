"""Queries of liquidity providing in walk-forward windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammlytics.operators import liquidity as L
from ammlytics.operators import research as R
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.plans.research import _IB, P
from ammlytics.session import materialised

_TAGS = {"theoretical": (False, False), "volcap": (True, False), "realistic": (True, True), "lvr_only": (False, True)}
_FEE = "CASE WHEN parts % 2 = 0 THEN 0.0025 ELSE 0.003 END"
_GAS = "CASE WHEN chain = 'chain0' THEN 0.2 WHEN chain = 'chain1' THEN 3.0 ELSE 0.05 END"
_LP = f"""{_IB}, mt AS (SELECT pair_address, reserve_usd * 10 AS reserve, CAST({_FEE} AS DOUBLE) AS fee, CAST({_GAS} AS DOUBLE) AS gas FROM meta),
bb AS (SELECT *, i // 45 AS b, i % 45 AS k FROM ib), bs AS (SELECT pair_address, b, sum(volume) AS v, count(*) AS n FROM bb GROUP BY 1, 2),
wn AS (SELECT *, lag(v, 2) OVER (PARTITION BY pair_address ORDER BY b) + lag(v) OVER (PARTITION BY pair_address ORDER BY b) AS isv FROM bs),
wi AS (SELECT w.pair_address, b, b - 2 AS win, isv * fee / reserve / 90 AS is_yield, reserve, fee, gas, greatest(50, 0.0025 * reserve) AS pos FROM wn w JOIN mt USING (pair_address) WHERE b >= 2 AND n = 45),
walk AS (SELECT pair_address, b, k, close AS mid, 0 AS moves FROM bb WHERE k = 0 UNION ALL SELECT x.pair_address, x.b, x.k, CASE WHEN x.close < w.mid / 1.3 OR x.close > w.mid * 1.3 THEN x.close ELSE w.mid END, w.moves + CASE WHEN x.close < w.mid / 1.3 OR x.close > w.mid * 1.3 THEN 1 ELSE 0 END FROM walk w JOIN bb x ON x.pair_address = w.pair_address AND x.b = w.b AND x.k = w.k + 1),
mv AS (SELECT pair_address, b, max(moves) AS moves FROM walk GROUP BY 1, 2),
ag AS (SELECT x.pair_address, x.b, sum(volume) FILTER (WHERE k > 0) AS vol, sum(least(volume, 3 * reserve)) FILTER (WHERE k > 0) AS volc, sum(ln(close / p) ** 2) FILTER (WHERE k > 0) AS var, arg_max(close, k) / arg_min(close, k) AS ratio FROM (SELECT *, lag(close) OVER (PARTITION BY pair_address ORDER BY i) AS p FROM bb) x JOIN mt USING (pair_address) GROUP BY 1, 2),
tg(tag, cap, arb) AS (VALUES {', '.join(f"('{k}', {str(a).lower()}, {str(b).lower()})" for k, (a, b) in _TAGS.items())}), md(mode, boost) AS (VALUES ('full', 1.0::DOUBLE), ('band', 1 / (1 - sqrt(1 / 1.3::DOUBLE)))),
pr AS MATERIALIZED (SELECT *, fees + il + gas_frac + lvr AS net, (fees + il + gas_frac + lvr) * 365 / 45 AS apr FROM (SELECT tag, wi.pair_address, win, mode, is_yield, pos, pos / (reserve + pos) AS share, CASE WHEN cap THEN volc ELSE vol END * fee * pos / (reserve + pos) * boost / pos AS fees,
 CASE WHEN mode = 'band' THEN least(greatest((2 * sqrt(ratio) / (1 + ratio) - 1) * boost, -1), 0) ELSE 2 * sqrt(ratio) / (1 + ratio) - 1 END AS il, -(2 + CASE WHEN mode = 'band' THEN moves ELSE 0 END) * gas / pos AS gas_frac, CASE WHEN arb THEN -0.125 * var * boost ELSE 0 END AS lvr, CASE WHEN mode = 'band' THEN moves ELSE 0 END AS moves
 FROM wi JOIN ag USING (pair_address, b) JOIN mv USING (pair_address, b), tg, md))"""


def wins(t):
    meta = t.meta.select(P, (F.col("reserve_usd") * 10).alias("reserve"), F.expr(_FEE).cast("double").alias("fee"), F.expr(_GAS).cast("double").alias("gas"))
    return materialised(L.windows(R.numbered(t.bars).select(P, "i", "close", "volume"), meta))


@query("lp_windows", f"WITH RECURSIVE {_LP} SELECT pair_address, CAST(win AS BIGINT) AS win, mode, round(is_yield, 8) AS is_yield, round(fees, 8) AS fees, round(il, 8) AS il, round(gas_frac, 8) AS gas_frac, round(lvr, 8) AS lvr, round(apr, 6) AS apr, moves, round(1 - moves / 44.0, 6) AS in_range FROM pr WHERE tag = 'realistic'")
def _(t):
    """Every out-of-sample window of every pool, over the full range and in a band that follows the price: fees, divergence, gas, loss to arbitrage."""
    out = L.provided(wins(t)).select(P, "win", "mode", "is_yield", "fees", "il", "gas_frac", "lvr", "apr", "moves", "in_range")
    digits = {"apr": 6, "in_range": 6}
    return out.select(*[F.round(c, digits.get(c, 8)).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("lp_selection", f"""WITH RECURSIVE {_LP}, lg AS (SELECT tag, mode, win FROM pr GROUP BY ALL HAVING count(*) >= 7), px AS (SELECT pr.* FROM pr JOIN lg USING (tag, mode, win)),
al AS (SELECT tag, mode, count(*) AS n, median(apr) AS apr_median, avg(apr) AS apr_mean, avg(CASE WHEN apr > 0 THEN 1.0 ELSE 0 END) AS positive FROM pr GROUP BY 1, 2),
rl AS (SELECT tag, mode, median(apr) AS picked_median, avg(apr) AS picked_mean, avg(CASE WHEN apr > 0 THEN 1.0 ELSE 0 END) AS picked_positive FROM (SELECT *, row_number() OVER (PARTITION BY tag, mode, win ORDER BY round(is_yield, 12) DESC, pair_address) AS r FROM px) WHERE r <= 5 GROUP BY 1, 2),
dr AS MATERIALIZED (SELECT win, pair_address, seed FROM (SELECT *, row_number() OVER (PARTITION BY win, seed ORDER BY md5(concat_ws('|', 'lp', CAST(seed AS STRING), CAST(win AS STRING), pair_address)), pair_address) AS r FROM (SELECT DISTINCT win, pair_address FROM px), range(0, 300) g(seed)) WHERE r <= 5),
nl AS (SELECT tag, mode, win, seed, avg(apr) AS m FROM px JOIN dr USING (win, pair_address) GROUP BY ALL),
pv AS (SELECT nl.tag, nl.mode, avg(m) AS null_mean, stddev_pop(m) AS null_sd, avg(CASE WHEN round(m, 9) >= round(picked_mean, 9) THEN 1.0 ELSE 0 END) AS p FROM nl JOIN rl USING (tag, mode) GROUP BY 1, 2)
SELECT tag, mode, n, round(apr_median, 6) AS apr_median, round(apr_mean, 6) AS apr_mean, round(positive, 6) AS positive, round(picked_median, 6) AS picked_median, round(picked_mean, 6) AS picked_mean, round(picked_positive, 6) AS picked_positive, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(p, 6) AS p, round((picked_mean - null_mean) / (null_sd + 1e-12), 4) AS z FROM al JOIN rl USING (tag, mode) JOIN pv USING (tag, mode)""")
def _(t):
    """Of each window the five pools with the best in-sample yield against five at random, 300 times: with and without a cap of volume and the loss to arbitrage."""
    w = wins(t)
    rows = None
    for tag, (capped, arbitraged) in _TAGS.items():
        one = L.provided(w, capped=capped, arbitraged=arbitraged).withColumn("tag", F.lit(tag))
        rows = one if rows is None else rows.unionByName(one)
    out = L.selection(materialised(rows), ["tag", "mode"])
    return rounded(out.drop("z")).join(out.select("tag", "mode", F.round("z", 4).alias("z")), ["tag", "mode"])
