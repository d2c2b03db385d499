"""Screeners, bars, flow features, record merges, holder balances: aggregates over the trade tape and its dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions.ordered import counted, quantiles

FAR = 9_223_372_036_854_775_807


def latest(value: str, *order: str | Column) -> Column:
    """The value of the last row in order, rows with a null value left out."""
    v = F.col(value)
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return F.max_by(v, F.when(v.isNotNull(), key))


def earliest(value: str, *order: str | Column) -> Column:
    v = F.col(value)
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return F.min_by(v, F.when(v.isNotNull(), key))


def side_sum(side: str, amount: str = "amount_usd") -> Column:
    return F.sum(F.when(F.col("side") == side, F.coalesce(F.col(amount), F.lit(0.0))).otherwise(0.0))


def top_tokens(trades: DataFrame, chain: str | None = None, since: int | None = None, limit: int = 25) -> DataFrame:
    """Pairs by traded volume."""
    rows = trades
    if chain is not None:
        rows = rows.where(F.col("chain") == chain)
    if since is not None:
        rows = rows.where(F.col("sec") >= since)
    out = rows.groupBy("chain", "pair_address").agg(F.sum(F.coalesce("amount_usd", F.lit(0.0))).alias("volume_usd"), side_sum("buy").alias("buy_usd"), side_sum("sell").alias("sell_usd"), F.count("*").alias("n_trades"))
    return out.orderBy(F.desc("volume_usd"), "pair_address").limit(limit)


ORDERS = ("volume_usd", "n_trades", "liquidity_usd", "last_price", "n_buys", "n_sells", "age_days", "holder_count")


def screener(trades: DataFrame, universe: DataFrame | None = None, holders: DataFrame | None = None, *, chain: str | None = None, dex: str | None = None, min_volume: float | None = None, min_liquidity: float | None = None, order_by: str = "volume_usd", descending: bool = True, limit: int | None = 100) -> DataFrame:
    """A row for each pair: activity, last price and liquidity, pool age, latest holder snapshot; filtered, ordered (nulls last), limited (None: all, unordered).

    Both joins meet a side that is aggregated to one row a key first, so no trade row is multiplied.
    """
    rows = trades if chain is None else trades.where(F.col("chain") == chain)
    place = ("block_number", "log_index")
    out = rows.groupBy("chain", "pair_address").agg(
        F.min("dex").alias("dex"),
        F.min("sec").alias("first_sec"),
        F.max("sec").alias("last_sec"),
        F.count("*").alias("n_trades"),
        F.sum(F.coalesce("amount_usd", F.lit(0.0))).alias("volume_usd"),
        side_sum("buy").alias("buy_usd"),
        side_sum("sell").alias("sell_usd"),
        F.count_if(F.col("side") == "buy").alias("n_buys"),
        F.count_if(F.col("side") == "sell").alias("n_sells"),
        latest("price_usd", "sec", *place).alias("last_price"),
        latest("reserve_usd", "sec", *place).alias("liquidity_usd"),
    )
    if universe is not None:
        born = universe.groupBy("chain", "pair_address").agg(F.min("created_sec").alias("created_sec"))
        out = out.join(born, ["chain", "pair_address"], "left")
    else:
        out = out.withColumn("created_sec", F.lit(None).cast("long"))
    start = F.coalesce("created_sec", "first_sec")
    out = out.withColumn("age_days", F.floor(F.col("last_sec") / 86400) - F.floor(start / 86400))
    if holders is not None:
        snap = holders.groupBy("chain", F.col("address").alias("pair_address")).agg(latest("holder_count", "observed_at", "seq").alias("holder_count"))
        out = out.join(snap, ["chain", "pair_address"], "left")
    else:
        out = out.withColumn("holder_count", F.lit(None).cast("long"))
    for column, least in (("volume_usd", min_volume), ("liquidity_usd", min_liquidity)):
        if least is not None:
            out = out.where(F.col(column) >= least)
    if dex is not None:
        out = out.where(F.col("dex") == dex)
    if limit is None:
        return out
    key = F.col(order_by if order_by in ORDERS else "volume_usd")
    return out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "chain", "pair_address").limit(limit)


def text_screen(screen: DataFrame, text: str) -> DataFrame:
    """Rows whose pair, venue or chain contains text in any case, with the buy share in whole percent (null without volume)."""
    hit = F.lower(F.concat_ws(" ", "pair_address", "dex", "chain")).contains(text.lower())
    total = F.col("buy_usd") + F.col("sell_usd")
    return screen.where(hit).withColumn("buy_share", F.round(F.try_divide(100 * F.col("buy_usd"), F.nullif(total, F.lit(0.0)))))


def ohlcv(trades: DataFrame, seconds: int, *, price: str = "price_usd", by_place: bool = True) -> DataFrame:
    """Bars of ``seconds``: first, highest, lowest, last price, volume and count; trades without a price make none."""
    order = (F.col("sec"), F.coalesce("block_number", F.lit(FAR)), F.coalesce("log_index", F.lit(FAR))) if by_place else (F.col("sec"),)
    rows = trades.where(F.col(price).isNotNull()).withColumn("bucket", F.col("sec") - F.pmod("sec", F.lit(seconds)))
    return rows.groupBy("chain", "pair_address", "bucket").agg(
        F.min_by(price, F.struct(*order)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(*order)).alias("close"), F.sum(F.coalesce("amount_usd", F.lit(0.0))).alias("volume"), F.count("*").alias("n_trades")
    )


def flow_bars(trades: DataFrame, seconds: int = 3600) -> DataFrame:
    """Hourly last price and reserve by (block, log), and bought and sold USD; the last reserve may be null."""
    key = F.struct(F.coalesce("block_number", F.lit(FAR)), F.coalesce("log_index", F.lit(FAR)))
    rows = trades.where("price_usd > 0").withColumn("hour", F.floor(F.col("sec") / seconds))
    return rows.groupBy("pair_address", "hour").agg(F.max_by("price_usd", key).alias("price"), F.max_by("reserve_usd", key).alias("reserve"), side_sum("buy").alias("buy_usd"), side_sum("sell").alias("sell_usd"))


def order_flow(trades: DataFrame, seconds: int = 3600, whale_quantile: float = 0.95) -> DataFrame:
    """Hourly counts, signed volume, imbalance in [-1, 1], flow of trades over the pair's whale threshold, makers, median reserve."""
    hourly = trades.withColumn("hour", F.floor(F.col("sec") / seconds))
    rows = hourly.join(quantiles(trades, ["pair_address"], "amount_usd", {"whale": whale_quantile}), "pair_address", "left")
    sign = F.when(F.col("side") == "buy", 1.0).when(F.col("side") == "sell", -1.0).otherwise(0.0)
    net = F.sum(sign * F.col("amount_usd"))
    gross = F.sum(F.when(F.col("side").isNotNull(), F.col("amount_usd")).otherwise(0.0))
    buys, sells = F.count_if(F.col("side") == "buy"), F.count_if(F.col("side") == "sell")
    found = rows.groupBy("pair_address", "hour").agg(
        F.count("*").alias("n_trades"),
        buys.alias("n_buy"),
        sells.alias("n_sell"),
        net.alias("net_usd"),
        F.coalesce(F.try_divide(net, F.nullif(gross, F.lit(0.0))), F.lit(0.0)).alias("ofi_usd"),
        F.coalesce(F.try_divide((buys - sells).cast("double"), F.nullif((buys + sells).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("ofi_cnt"),
        F.sum(F.when(F.col("amount_usd") >= F.col("whale"), sign * F.col("amount_usd")).otherwise(0.0)).alias("whale_net_usd"),
        F.count_distinct("maker").alias("n_makers"),
    )
    return found.join(quantiles(hourly, ["pair_address", "hour"], "reserve_usd", {"reserve_usd": 0.5}), ["pair_address", "hour"], "left")


def best_by_priority(rows: DataFrame, key: list[str], priority: str, fields: list[str], source: str) -> DataFrame:
    """Of records of one key from several sources: each field's first non-empty value in order of priority; sources that exist joined by '+'."""
    full = {f: F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in fields}
    picks = [F.min_by(F.col(f), F.when(full[f], F.col(priority))).alias(f) for f in fields]
    names = F.transform(F.array_sort(F.collect_set(F.struct(priority, source))), lambda x: x[source])
    return rows.groupBy(*key).agg(*picks, F.array_join(F.array_distinct(names), "+").alias("source"))


def worst_case(rows: DataFrame, key: list[str], numbers: list[str], flags: list[str], lists: list[str]) -> DataFrame:
    """Largest number, true if any vote is true (null without votes), sorted distinct union of the lists."""
    aggs = [F.max(n).alias(n) for n in numbers] + [F.bool_or(f).alias(f) for f in flags]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in lists]
    return rows.groupBy(*key).agg(*aggs)


def balances(transfers: DataFrame, keys: list[str], burn: list[str], to_block: int | None = None) -> DataFrame:
    """Net positive balances by holder, up to a block; burn addresses are no holders."""
    rows = transfers.where("value <> 0")
    if to_block is not None:
        rows = rows.where(F.col("block") <= to_block)
    legs = rows.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("holder"), (-F.col("value")).alias("v")), F.struct(F.col("dst").alias("holder"), F.col("value").alias("v")))).alias("x"))
    out = legs.select(*keys, "x.holder", "x.v").where(~F.col("holder").isin(*burn))
    return out.groupBy(*keys, "holder").agg(F.sum("v").alias("balance")).where("balance > 0")


def supply(transfers: DataFrame, keys: list[str], burn: list[str]) -> DataFrame:
    """Minted and burned totals."""
    return transfers.groupBy(*keys).agg(F.sum(F.when(F.col("src").isin(*burn), F.col("value")).otherwise(0)).alias("minted"), F.sum(F.when(F.col("dst").isin(*burn), F.col("value")).otherwise(0)).alias("burned"))


def concentration(held: DataFrame, keys: list[str], tops: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Holders, total, shares of the largest, Herfindahl index and Gini coefficient of balances.

    From one row for each different balance with the number of smaller ones: no task holds the holders of a token.
    """
    v = counted(held, keys, "balance")
    n, balance, c = F.max("n"), F.col("balance"), F.col("c")
    larger = F.col("n") - F.col("before") - c
    places = F.col("before") * c + F.floor(c * (c + 1) / 2)  # sum of the places that c equal balances have, from the smallest
    totals = v.groupBy(*keys).agg(n.alias("n_holders"), F.sum(balance * c).alias("total"), F.sum(places * balance).cast("double").alias("_w"), F.sum(c * F.pow(balance.cast("double"), F.lit(2.0))).alias("_q"), *[F.sum(balance * F.greatest(F.least(c, F.lit(t) - larger), F.lit(0))).alias(f"_t{t}") for t in tops])
    whole, holders = F.col("total").cast("double"), F.col("n_holders")
    shares = [(F.col(f"_t{t}") / whole).alias(f"top{t}") for t in tops]
    return totals.select(*keys, "n_holders", "total", *shares, (F.col("_q") / (whole * whole)).alias("hhi"), (2 * F.col("_w") / (holders * whole) - (holders + 1) / holders).alias("gini"))


def wallet_position(transfers: DataFrame, keys: list[str], price: float) -> DataFrame:
    """In, out and position of each wallet, valued at a price; nothing is realised."""
    legs = transfers.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("wallet"), F.lit(0).cast("long").alias("i"), F.col("value").alias("o")), F.struct(F.col("dst").alias("wallet"), F.col("value").alias("i"), F.lit(0).cast("long").alias("o")))).alias("x")).select(*keys, "x.*")
    return legs.groupBy(*keys, "wallet").agg(F.sum("i").alias("received"), F.sum("o").alias("sent")).withColumns({"position": F.col("received") - F.col("sent"), "unrealised_usd": (F.col("received") - F.col("sent")) * F.lit(float(price)), "realised_usd": F.lit(0.0)})


def newest_first(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Distinct keys, newest first (a null order counts as 0)."""
    return rows.groupBy(key).agg(F.max(F.coalesce(order, F.lit(0))).alias(order)).orderBy(F.desc(order), key).limit(limit)


def first_of_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def liquidity_graph(pools: DataFrame) -> DataFrame:
    """Pools of a token: totals, reserves by venue and by fee tier (maps), share of the largest."""
    x = pools.where("reserve_usd > 0").withColumn("tier", F.concat(F.col("fee_bps").cast("string"), F.lit("bps")))

    def totals(column: str) -> DataFrame:
        part = x.groupBy("token", column).agg(F.sum("reserve_usd").alias("r"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col(column).alias("k"))))
        return part.groupBy("token").agg(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["k"], -e["o"]))).alias(f"by_{column}"))

    main = x.groupBy("token").agg(F.count("*").alias("n_pools"), F.sum("reserve_usd").alias("total_usd"), (F.max("reserve_usd") / F.sum("reserve_usd")).alias("dominant_share"))
    return main.join(totals("dex"), "token").join(totals("tier"), "token")


def distribution(rows: DataFrame, value: str, by: list[str] | None = None, clip: float = 10.0) -> DataFrame:
    """Count, quantiles, clipped mean and share above zero of a column; infinite values count in the mean (clipped) but not in quantiles."""
    v = F.col(value)
    finite = F.when(~v.isin(float("inf"), float("-inf")) & ~F.isnan(v), v)
    by = by or []
    sums = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(F.least(v, F.lit(clip))).alias("mean"), F.avg((v > 0).cast("double")).alias("positive"))
    q = quantiles(rows.select(*by, finite.alias("_v")), by, "_v", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    if not by:
        return sums.join(F.broadcast(q))  # one row each
    q = q.withColumnsRenamed({k: f"_k_{k}" for k in by})
    return sums.join(q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], "left").drop(*[f"_k_{k}" for k in by])
