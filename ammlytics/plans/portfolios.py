"""Queries of walk-forward portfolios over streams of simulated trades: weights, daily metrics, the dollar book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammlytics.operators import portfolio as B
from ammlytics.operators import research as R
from ammlytics.plans.market import rounded
from ammlytics.plans.registry import query
from ammlytics.plans.research import _IB, P, _sim_sql, ib
from ammlytics.session import materialised

_BRACKETS = {"roc_rev": (0.15, 0.1, 10), "donchian_bo": (0.3, 0.1, 7)}
AUMS = [1e3, 1e4, 3e4, 1e5, 3e5, 1e6, 3e6, 1e7, 3e7, 1e8]


def trades(t):
    """stream, entry_day, exit_day, ret net of a cost, cap of all pairs and families."""
    b = materialised(ib(t))
    out = None
    for family, (tp, sl, hold) in _BRACKETS.items():
        x = R.simulate(R.signal(b, family), tp, sl, hold).select(P, "i", "j", F.round(F.col("ret") - 0.01, 9).alias("ret"), F.lit(family).alias("family"))
        out = x if out is None else out.unionByName(x)
    day = b.select(P, F.col("i").alias("_i"), "day")
    out = out.join(day.withColumnsRenamed({"_i": "i", "day": "entry_day"}), [P, "i"]).join(day.withColumnsRenamed({"_i": "j", "day": "exit_day"}), [P, "j"])
    out = out.join(t.meta.select(P, F.greatest(F.lit(50.0), 0.25 * F.col("reserve_usd")).alias("cap")), P)
    return materialised(out.select(F.concat_ws(":", P, "family").alias("stream"), "entry_day", "exit_day", "ret", "cap"))


def days_of(tape):
    return materialised(B.stream_days(tape).withColumn("r", F.round("r", 9)))


def _stream_sql(family):
    extra = "SELECT t.pair_address, a.day AS entry_day, z.day AS exit_day, CAST(ret AS DOUBLE) AS ret FROM t JOIN ib a ON a.pair_address = t.pair_address AND a.i = t.i JOIN ib z ON z.pair_address = t.pair_address AND z.i = t.j"
    return f"SELECT concat_ws(':', x.pair_address, '{family}') AS stream, entry_day, exit_day, round(ret - 0.01, 9) AS ret, greatest(50, 0.25 * reserve_usd) AS cap FROM ({_sim_sql(family, *_BRACKETS[family], extra=extra)}) x JOIN meta USING (pair_address)"


_KINDS = {"ew_pos": ("ew", True), "ew_all": ("ew", False), "invvol_pos": ("invvol", True)}
_HELD = f"""{_IB}, tape AS MATERIALIZED ({' UNION ALL '.join(_stream_sql(f) for f in _BRACKETS)}),
sd AS MATERIALIZED (SELECT stream, exit_day AS day, round(avg(ret), 9) AS r FROM tape GROUP BY 1, 2), ends AS (SELECT min(day) AS a, max(day) AS z FROM sd),
reb AS MATERIALIZED (SELECT block, coalesce(lead(block) OVER (ORDER BY block), z + 1) AS block_end FROM (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS block, a, z FROM ends) WHERE block > a + 90),
seen AS (SELECT block, stream, day, r FROM sd JOIN reb ON day < block AND day >= block - 360), dd AS (SELECT block, count(DISTINCT day) AS d FROM seen GROUP BY 1),
dense AS (SELECT s.block, s.stream, x.day FROM (SELECT DISTINCT block, stream FROM seen) s JOIN (SELECT DISTINCT block, day FROM seen) x USING (block)),
st AS (SELECT block, stream, count(seen.r) AS n, avg(seen.r) AS mean, stddev_samp(coalesce(seen.r, 0)) AS sd FROM dense LEFT JOIN seen USING (block, stream, day) GROUP BY 1, 2 HAVING count(seen.r) >= 4),
kinds(config, kind, pos) AS (VALUES ('ew_pos', 'ew', true), ('ew_all', 'ew', false), ('invvol_pos', 'invvol', true)),
u AS (SELECT config, block, stream, CASE WHEN kind = 'ew' THEN 1.0::DOUBLE WHEN round(sd, 9) > 0 THEN 1 / sd ELSE 0 END AS u FROM st, kinds WHERE NOT pos OR round(mean, 9) > 0),
held AS MATERIALIZED (SELECT config, block, stream, CASE WHEN sum(u) OVER b > 0 THEN u / sum(u) OVER b ELSE 1.0 / count(*) OVER b END AS weight FROM u WINDOW b AS (PARTITION BY config, block))"""
_METRICS = """SELECT {keys}, n, CASE WHEN f THEN mu * 365 END AS ann_ret, CASE WHEN f THEN sd * sqrt(365) END AS ann_vol, CASE WHEN f THEN mu / sd * sqrt(365) END AS sharpe, CASE WHEN f THEN dd END AS max_dd, CASE WHEN f AND dd < 0 THEN mu * 365 / -dd END AS calmar
 FROM (SELECT {keys}, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd, min(dd) AS dd, count(*) >= 5 AND round(stddev_samp(r), 12) > 0 AS f FROM (SELECT *, e / max(e) OVER (PARTITION BY {keys} ORDER BY day) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {keys} ORDER BY day)) AS e FROM {daily})) GROUP BY {keys})"""


@query("walk_forward_weights", f"WITH {_HELD} SELECT config, block, stream, round(weight, 6) AS weight FROM held")
def _(t):
    """Weights of streams at each month's start from the 360 days before it: equal (of all, or of those with a positive mean) and by inverse deviation."""
    days = days_of(trades(t))
    trail = materialised(B.trailing(days, B.rebalances(days)))
    parts = [B.weights(trail, kind, pos).select(F.lit(name).alias("config"), "block", "stream", F.round("weight", 6).alias("weight")) for name, (kind, pos) in _KINDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DAILY = """now AS (SELECT h.config, sd.day, sum(weight * r) / nullif(sum(weight), 0) AS r FROM sd JOIN reb ON day >= reb.block AND day < block_end JOIN held h ON h.block = reb.block AND h.stream = sd.stream GROUP BY 1, 2),
plain AS (SELECT c.config, d.day, coalesce(now.r, 0) AS r FROM (SELECT DISTINCT config FROM held) c CROSS JOIN (SELECT DISTINCT day FROM sd) d LEFT JOIN now ON now.config = c.config AND now.day = d.day),
target AS (SELECT config || '_voltgt20' AS config, day, r * coalesce(least(0.2 / sqrt(365) / CASE WHEN c = 30 AND round(s, 9) > 0 THEN s END, 5), 1) AS r FROM (SELECT *, count(r) OVER m AS c, stddev_samp(r) OVER m AS s FROM plain WINDOW m AS (PARTITION BY config ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))),
daily AS (SELECT * FROM plain UNION ALL SELECT * FROM target)"""
_TURN = """bl AS (SELECT config, block, count(*) AS m, lead(block) OVER (PARTITION BY config ORDER BY block) AS nxt FROM held GROUP BY 1, 2), ch AS (SELECT config, block, sum(abs(w)) AS c FROM (SELECT config, block, stream, sum(w) AS w FROM (SELECT h.config, b.nxt AS block, stream, -weight AS w FROM held h JOIN bl b ON b.config = h.config AND b.block = h.block WHERE nxt IS NOT NULL UNION ALL SELECT h.config, h.block, stream, weight FROM held h JOIN bl b ON b.config = h.config AND b.nxt = h.block) GROUP BY 1, 2, 3) GROUP BY 1, 2),
turn AS (SELECT bl.config, (SELECT avg(c) FROM ch WHERE ch.config = bl.config) AS turnover, avg(m) AS streams FROM bl GROUP BY 1)"""


@query("walk_forward_portfolio", f"WITH {_HELD}, {_DAILY}, {_TURN}, me AS ({_METRICS.format(keys='config', daily='daily')}) SELECT me.config, me.n, round(ann_ret, 4) AS ann_ret, round(ann_vol, 4) AS ann_vol, round(sharpe, 4) AS sharpe, round(max_dd, 4) AS max_dd, round(calmar, 4) AS calmar, round(turnover, 4) AS turnover, round(streams, 4) AS streams FROM me JOIN turn ON turn.config = replace(me.config, '_voltgt20', '')")
def _(t):
    """Daily returns of the walk-forward portfolios, plain and scaled to 20 % of volatility, with turnover and number of streams."""
    days = days_of(trades(t))
    blocks = B.rebalances(days)
    trail = materialised(B.trailing(days, blocks))
    daily = turned = None
    for name, (kind, pos) in _KINDS.items():
        held = materialised(B.weights(trail, kind, pos))
        one, turn = (x.withColumn("config", F.lit(name)) for x in (B.portfolio_days(days, blocks, held), B.turnover(held)))
        daily, turned = (one, turn) if daily is None else (daily.unionByName(one), turned.unionByName(turn))
    both = daily.unionByName(B.vol_target(daily, ["config"], 0.2).withColumn("config", F.concat("config", F.lit("_voltgt20"))))
    m = B.metrics(both, ["config"]).withColumn("plain", F.regexp_replace("config", "_voltgt20", ""))
    return rounded(m.join(turned.withColumnRenamed("config", "plain"), "plain").drop("plain"), 4)


@query("dollar_book", f"""WITH {_HELD}, book AS MATERIALIZED (SELECT a.aum, tape.stream, entry_day, exit_day, ret, weight * aum AS target, least(weight * aum, cap) AS notional FROM tape JOIN reb ON entry_day >= reb.block AND entry_day < block_end JOIN held h ON h.config = 'invvol_pos' AND h.block = reb.block AND h.stream = tape.stream, (SELECT unnest({AUMS})::DOUBLE AS aum) a),
span AS (SELECT aum, min(exit_day) AS a, max(exit_day) AS z FROM book GROUP BY 1), spine AS (SELECT aum, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
pd AS (SELECT aum, exit_day AS day, sum(notional * ret) AS pnl FROM book GROUP BY 1, 2),
op AS (SELECT s.aum, s.day, coalesce(sum(b.notional), 0) AS open FROM spine s LEFT JOIN book b ON b.aum = s.aum AND b.entry_day <= s.day AND b.exit_day > s.day GROUP BY 1, 2),
dy AS (SELECT s.aum, s.day, coalesce(pnl, 0) / s.aum AS r, open FROM spine s JOIN op USING (aum, day) LEFT JOIN pd ON pd.aum = s.aum AND pd.day = s.day), me AS ({_METRICS.format(keys='aum', daily='dy')}),
su AS (SELECT aum, count(*) AS trades, sum(notional) / sum(target) AS deployed FROM book GROUP BY 1), wk AS (SELECT aum, max(open) / aum AS peak_open, avg(open) / aum AS mean_open, count(*) FILTER (WHERE round(open, 6) = 0) AS cash_days FROM dy GROUP BY 1)
SELECT aum, trades, round(deployed, 6) AS deployed, n, round(ann_ret, 6) AS ann_ret, round(ann_vol, 6) AS ann_vol, round(sharpe, 4) AS sharpe, round(max_dd, 6) AS max_dd, round(calmar, 4) AS calmar, round(peak_open, 6) AS peak_open, round(mean_open, 6) AS mean_open, cash_days FROM su JOIN me USING (aum) JOIN wk USING (aum)""")
def _(t):
    """Ten sizes of a book that puts each stream's weight to work, no more than the stream's pool bears; the rest is cash."""
    tape = trades(t)
    days = days_of(tape)
    blocks = B.rebalances(days)
    held = materialised(B.weights(B.trailing(days, blocks), "invvol"))
    out = B.capacity(materialised(B.booked(tape, held, blocks, AUMS)))
    digits = {"sharpe": 4, "calmar": 4}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if k == "double" and c != "aum" else F.col(c) for c, k in out.dtypes])


@query("equal_risk_weights")
def _(t):
    """Weights of equal risk contribution at each month's start from the 360 days before it."""
    days = days_of(trades(t))
    return rounded(B.equal_risk(days, B.rebalances(days)))
