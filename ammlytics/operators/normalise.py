"""Normalisers: landed responses of data services, one JSON text a row (``body``), as records of the lake's schemas.

Each is one parse with a declared schema and one select; leaves are read as text and coerced leniently (what isn't a number is null), so a
service that changes a type breaks no job. Times are epoch seconds. Columns of the landed table other than body are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions import columns as C

#: What services call the chains that the lake knows.
CHAIN_NAMES = {"bsc": "bsc", "bnb": "bsc", "binance-smart-chain": "bsc", "56": "bsc", "solana": "solana", "sol": "solana"}
#: Addresses that own or hold what nobody can move.
BURN = ("0x000000000000000000000000000000000000dead", "0x0000000000000000000000000000000000000000")
#: Tokens of a bonding curve that are never sold, and those it begins with.
CURVE_RESERVED, CURVE_INITIAL = 206_900_000.0, 793_100_000.0


def parsed(landed: DataFrame, schema: str) -> DataFrame:
    return landed.withColumn("m", F.from_json("body", schema)).drop("body")


def num(path: str) -> Column:
    return C.to_number(F.col(path))


def whole(path: str) -> Column:
    return F.col(path).try_cast("long")


def known_chain(name: Column) -> Column:
    """The lake's chain of a service's name for it; null for others."""
    x = F.lower(F.trim(name))
    out = F.when(x == next(iter(CHAIN_NAMES)), F.lit(CHAIN_NAMES[next(iter(CHAIN_NAMES))]))
    for k, v in list(CHAIN_NAMES.items())[1:]:
        out = out.when(x == k, F.lit(v))
    return out


def iso_seconds(x: Column) -> Column:
    """Seconds of an ISO time (Z or an offset; without either UTC); null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(x))


def tax_fraction(x: Column) -> Column:
    """A percent number as a fraction."""
    return C.to_number(x) / 100


def any_of(*paths: str) -> Column:
    return F.coalesce(*[F.col(p) for p in paths])


def flag_list(flags: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in flags]), lambda x: x.isNotNull())


# Pools and tokens ---------------------------------------------------------------------------------------------------------------

PAIR = """chainId STRING, dexId STRING, pairAddress STRING, url STRING, baseToken STRUCT<address: STRING, symbol: STRING, name: STRING>, quoteToken STRUCT<address: STRING, symbol: STRING>,
 priceUsd STRING, priceNative STRING, liquidity STRUCT<usd: STRING, base: STRING, quote: STRING>, volume STRUCT<m5: STRING, h1: STRING, h24: STRING>, priceChange STRUCT<h24: STRING>,
 txns STRUCT<h24: STRUCT<buys: STRING, sells: STRING>>, fdv STRING, marketCap STRING, pairCreatedAt STRING"""


def pair_pools(landed: DataFrame) -> DataFrame:
    """A pair list's rows as pools; rows without an address or of an unknown chain are dropped."""
    p = parsed(landed, PAIR).withColumn("chain", known_chain(F.col("m.chainId"))).where("chain is not null and m.pairAddress <> ''")
    return p.select(
        *landed.drop("body").columns, "chain", F.col("m.dexId").alias("dex"), F.col("m.pairAddress").alias("pair_address"), F.col("m.baseToken.address").alias("base_address"), F.col("m.baseToken.symbol").alias("base_symbol"),
        F.col("m.quoteToken.address").alias("quote_address"), num("m.priceUsd").alias("price_usd"), num("m.priceNative").alias("price_native"), num("m.liquidity.usd").alias("liquidity_usd"), num("m.volume.h1").alias("volume_1h"),
        num("m.volume.h24").alias("volume_24h"), num("m.priceChange.h24").alias("price_change_24h"), whole("m.txns.h24.buys").alias("txns_24h_buys"), whole("m.txns.h24.sells").alias("txns_24h_sells"), num("m.fdv").alias("fdv"),
        num("m.marketCap").alias("market_cap"), F.floor(whole("m.pairCreatedAt") / 1000).alias("created_sec"),
    )


def tokens_of_pools(pools: DataFrame, tie: str = "pair_address") -> DataFrame:
    """Tokens of pools, by chain and normal base address: prices of the deepest pool, sums of liquidity and volume, number, earliest creation."""
    key = C.normal_address(F.col("chain"), F.col("base_address"))
    depth = F.struct(F.coalesce("liquidity_usd", F.lit(0.0)), tie)
    best = F.max_by(F.struct("price_usd", "market_cap", "base_symbol", "pair_address"), depth)
    g = pools.where("base_address <> ''").groupBy("chain", key.alias("address")).agg(
        best.alias("b"), F.sum(F.coalesce("liquidity_usd", F.lit(0.0))).alias("liquidity_usd"), F.sum(F.coalesce("volume_24h", F.lit(0.0))).alias("volume_24h"), F.count("*").alias("pair_count"), F.min("created_sec").alias("created_sec")
    )
    return g.select("chain", "address", F.col("b.base_symbol").alias("symbol"), F.col("b.price_usd").alias("price_usd"), F.col("b.market_cap").alias("market_cap"), F.col("b.pair_address").alias("deepest_pool"), "liquidity_usd", "volume_24h", "pair_count", "created_sec")


LISTED_POOL = """attributes STRUCT<address: STRING, base_token_price_usd: STRING, base_token_price_native_currency: STRING, reserve_in_usd: STRING, fdv_usd: STRING, market_cap_usd: STRING, volume_usd: STRUCT<m5: STRING, h1: STRING, h24: STRING>,
 price_change_percentage: STRUCT<h24: STRING>, transactions: STRUCT<h24: STRUCT<buys: STRING, sells: STRING>>, pool_created_at: STRING>,
 relationships STRUCT<base_token: STRUCT<data: STRUCT<id: STRING>>, quote_token: STRUCT<data: STRUCT<id: STRING>>, dex: STRUCT<data: STRUCT<id: STRING>>>"""


def without_network(token_id: Column) -> Column:
    """The address in "network_address"; an id without a network as it is."""
    return F.when(F.contains(token_id, F.lit("_")), F.substring_index(token_id, "_", -1)).otherwise(token_id)


def listed_pools(landed: DataFrame) -> DataFrame:
    """A pool list with related tokens as pools; the chain is the one in front of the base token's id."""
    p = parsed(landed, LISTED_POOL).where("m.attributes.address <> ''")
    base = F.col("m.relationships.base_token.data.id")
    return p.select(
        *landed.drop("body").columns, known_chain(F.substring_index(base, "_", 1)).alias("chain"), F.col("m.relationships.dex.data.id").alias("dex"), F.col("m.attributes.address").alias("pair_address"), without_network(base).alias("base_address"), F.lit(None).cast("string").alias("base_symbol"),
        without_network(F.col("m.relationships.quote_token.data.id")).alias("quote_address"), num("m.attributes.base_token_price_usd").alias("price_usd"), num("m.attributes.reserve_in_usd").alias("liquidity_usd"), num("m.attributes.market_cap_usd").alias("market_cap"),
        num("m.attributes.volume_usd.h24").alias("volume_24h"), whole("m.attributes.transactions.h24.buys").alias("txns_24h_buys"), iso_seconds(F.col("m.attributes.pool_created_at")).alias("created_sec"),
    )


TOKEN = """symbol STRING, name STRING, decimals STRING, totalSupply STRING, supply STRING, circulatingSupply STRING, price STRING, marketCap STRING, mc STRING, fdv STRING, realMc STRING, liquidity STRING, v1hUSD STRING, v24hUSD STRING, v24h STRING, volume24h STRING, holder STRING, holders STRING, holderCount STRING"""


def token_overview(landed: DataFrame) -> DataFrame:
    """An overview with keys of several versions: of each field the first that is there."""
    return parsed(landed, TOKEN).select(
        *landed.drop("body").columns, F.col("m.symbol").alias("symbol"), whole("m.decimals").alias("decimals"), C.to_number(any_of("m.totalSupply", "m.supply", "m.circulatingSupply")).alias("total_supply"), num("m.price").alias("price_usd"),
        C.to_number(any_of("m.marketCap", "m.mc")).alias("market_cap"), C.to_number(any_of("m.fdv", "m.realMc")).alias("fdv"), num("m.liquidity").alias("liquidity_usd"), C.to_number(any_of("m.v24hUSD", "m.v24h", "m.volume24h")).alias("volume_24h"),
        any_of("m.holder", "m.holders", "m.holderCount").try_cast("long").alias("holder_count"),
    )


# Bars ---------------------------------------------------------------------------------------------------------------------------


def listed_bars(landed: DataFrame) -> DataFrame:
    """Bars as lists [second, open, high, low, close, volume]; a bar without all four prices is dropped."""
    rows = landed.select(*landed.drop("body").columns, F.explode(F.from_json("body", "array<array<string>>")).alias("r")).where("size(r) >= 6")
    at = lambda i: C.to_number(F.col("r")[i])
    return rows.select(*landed.drop("body").columns, F.col("r")[0].try_cast("long").alias("sec"), *[at(i + 1).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))]).where("sec is not null and open is not null and high is not null and low is not null and close is not null")


ITEM = "unixTime STRING, unix_time STRING, t STRING, o STRING, open STRING, h STRING, high STRING, l STRING, low STRING, c STRING, close STRING, v STRING, volume STRING, trades STRING"


def paged_bars(landed: DataFrame, key: str, limit: int, page: str) -> DataFrame:
    """Bars of overlapping pages: one a second (the first page's), the newest ``limit`` of each key, without those that lack a price."""
    p = parsed(landed, ITEM).withColumn("sec", any_of("m.unixTime", "m.unix_time", "m.t").try_cast("long")).where("sec is not null")
    p = p.select(key, page, "sec", *[C.to_number(any_of(f"m.{s}", f"m.{n}")).alias(n) for s, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])
    once = p.groupBy(key, "sec").agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), page).alias("b")).select(key, "sec", "b.*").where("open is not null and high is not null and low is not null and close is not null")
    return once.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sec")))).where(F.col("r") <= limit).drop("r")


AGGREGATE = "Block STRUCT<Timefield: STRING>, Trade STRUCT<open: STRING, close: STRING, high: STRING, low: STRING>, volume STRING, count STRING"


def aggregated_bars(landed: DataFrame) -> DataFrame:
    """Bars that a service has aggregated; high and low fall back to the open, a bar without open or close is dropped."""
    p = parsed(landed, AGGREGATE).withColumn("sec", iso_seconds(F.col("m.Block.Timefield"))).where("sec is not null")
    o = num("m.Trade.open")
    return p.select(*landed.drop("body").columns, "sec", o.alias("open"), F.coalesce(num("m.Trade.high"), o).alias("high"), F.coalesce(num("m.Trade.low"), o).alias("low"), num("m.Trade.close").alias("close"), num("m.volume").alias("volume"), whole("m.count").alias("trade_count")).where("open is not null and close is not null")


# Trades -------------------------------------------------------------------------------------------------------------------------

LEG_TRADE = """`from` STRUCT<address: STRING, uiAmount: STRING, amount: STRING>, `to` STRUCT<address: STRING, uiAmount: STRING, amount: STRING>, side STRING, txType STRING, blockUnixTime STRING, unixTime STRING, txHash STRING, tx_hash STRING,
 priceUSD STRING, price STRING, volumeUSD STRING, volume_usd STRING, owner STRING, maker STRING, source STRING"""


def leg_trades(landed: DataFrame, token: Column) -> DataFrame:
    """Swaps given as two legs: the base leg is the one with the token's address (else the first); the side is named or follows from the type."""
    p = parsed(landed, LEG_TRADE)
    mine = F.lower(token)
    swapped = (F.lower(F.coalesce("m.to.address", F.lit(""))) == mine) & (F.lower(F.coalesce("m.from.address", F.lit(""))) != mine)
    amount = lambda leg: F.coalesce(F.col(f"m.{leg}.uiAmount"), F.col(f"m.{leg}.amount"))
    kind = F.lower(F.coalesce("m.txType", F.lit("")))
    side = F.coalesce(F.lower("m.side"), F.when(kind.isin("buy", "add"), "buy").when(kind.isin("sell", "remove"), "sell"))
    return p.select(
        *landed.drop("body").columns, any_of("m.blockUnixTime", "m.unixTime").try_cast("long").alias("sec"), any_of("m.txHash", "m.tx_hash").alias("tx_hash"), side.alias("side"), F.col("m.source").alias("dex"),
        C.to_number(any_of("m.priceUSD", "m.price")).alias("price_usd"), C.to_number(F.when(swapped, amount("to")).otherwise(amount("from"))).alias("amount_base"), C.to_number(F.when(swapped, amount("from")).otherwise(amount("to"))).alias("amount_quote"),
        C.to_number(any_of("m.volumeUSD", "m.volume_usd")).alias("amount_usd"), any_of("m.owner", "m.maker").alias("maker"),
    )


KIND_TRADE = "attributes STRUCT<block_timestamp: STRING, kind: STRING, to_token_amount: STRING, from_token_amount: STRING, price_to_in_usd: STRING, price_from_in_usd: STRING, volume_in_usd: STRING, tx_hash: STRING, tx_from_address: STRING>"


def kind_trades(landed: DataFrame) -> DataFrame:
    """Trades whose kind tells which amount is the base: bought it comes out, sold it goes in. Rows without a time are dropped."""
    p = parsed(landed, KIND_TRADE).withColumn("sec", iso_seconds(F.col("m.attributes.block_timestamp"))).where("sec is not null")
    buy = F.col("m.attributes.kind") == "buy"
    pick = lambda a, b: C.to_number(F.when(buy, F.col(f"m.attributes.{a}")).otherwise(F.col(f"m.attributes.{b}")))
    return p.select(*landed.drop("body").columns, "sec", F.col("m.attributes.kind").alias("side"), pick("price_to_in_usd", "price_from_in_usd").alias("price_usd"), pick("to_token_amount", "from_token_amount").alias("amount_base"), pick("from_token_amount", "to_token_amount").alias("amount_quote"), num("m.attributes.volume_in_usd").alias("amount_usd"), F.col("m.attributes.tx_from_address").alias("maker"))


GRAPH_TRADE = """Block STRUCT<Time: STRING>, Transaction STRUCT<Hash: STRING, `From`: STRING>, Trade STRUCT<Buy: STRUCT<Buyer: STRING, Currency: STRUCT<SmartContract: STRING>, Amount: STRING, Price: STRING, PriceInUSD: STRING>,
 Sell: STRUCT<Seller: STRING, Currency: STRUCT<SmartContract: STRING>, Amount: STRING, PriceInUSD: STRING>, Dex: STRUCT<ProtocolName: STRING, ProtocolFamily: STRING>>"""


def graph_trades(landed: DataFrame, base: Column) -> DataFrame:
    """Trades with a bought and a sold currency: a buy if the base was bought, a sell if it was sold, null where neither is the base."""
    p = parsed(landed, GRAPH_TRADE)
    b, s = "m.Trade.Buy", "m.Trade.Sell"
    bought, sold = F.lower(f"{b}.Currency.SmartContract") == F.lower(base), F.lower(f"{s}.Currency.SmartContract") == F.lower(base)
    amount, price = F.when(sold, num(f"{s}.Amount")).otherwise(num(f"{b}.Amount")), F.when(sold, num(f"{s}.PriceInUSD")).otherwise(F.coalesce(num(f"{b}.PriceInUSD"), num(f"{s}.PriceInUSD")))
    return p.select(*landed.drop("body").columns, iso_seconds(F.col("m.Block.Time")).alias("sec"), F.when(bought, "buy").when(sold, "sell").alias("side"), F.coalesce("m.Trade.Dex.ProtocolName", "m.Trade.Dex.ProtocolFamily").alias("dex"), price.alias("price_usd"), amount.alias("amount_base"), (amount * price).alias("amount_usd"), F.coalesce(f"{b}.Buyer", "m.Transaction.From").alias("maker"))


# Launches -----------------------------------------------------------------------------------------------------------------------

LAUNCH = "tokenAddress STRING, mint STRING, name STRING, symbol STRING, fullyDilutedValuation STRING, marketCap STRING, bondingCurveProgress STRING, bondingProgress STRING, graduatedAt STRING, createdAt STRING"


def launch_feed(landed: DataFrame, graduated: Column) -> DataFrame:
    """New, bonding and graduated tokens: progress as a fraction (1 for graduated ones), complete or null."""
    p = parsed(landed, LAUNCH)
    progress = F.when(graduated, 1.0).otherwise(C.to_fraction(any_of("m.bondingCurveProgress", "m.bondingProgress")))
    return p.select(*landed.drop("body").columns, any_of("m.tokenAddress", "m.mint").alias("address"), F.col("m.name").alias("name"), F.coalesce(F.nullif(num("m.fullyDilutedValuation"), F.lit(0.0)), num("m.marketCap")).alias("market_cap_usd"), progress.alias("bonding_curve_progress"), F.when(graduated, F.lit(True)).alias("complete"), F.when(graduated, iso_seconds(F.col("m.graduatedAt"))).alias("graduated_sec"), iso_seconds(F.col("m.createdAt")).alias("created_sec"))


CURVE = "create STRUCT<time: STRING, signer: STRING, name: STRING>, pool STRUCT<base: STRING, quote_usd: STRING, name: STRING>, migrate ARRAY<STRUCT<time: STRING, mints: ARRAY<STRING>>>"


def curve_launches(landed: DataFrame, mint: Column) -> DataFrame:
    """Launches of curve tokens: progress from what the curve still holds; complete at 1 or once a migration names the mint. Without creation and pool no launch."""
    p = parsed(landed, CURVE).where("m.create is not null or m.pool is not null")
    progress = F.least(F.greatest(1 - (num("m.pool.base") - CURVE_RESERVED) / CURVE_INITIAL, F.lit(0.0)), F.lit(1.0))
    progress = F.when(num("m.pool.base").isNotNull(), progress)
    moved = F.filter("m.migrate", lambda x: F.array_contains(x["mints"], mint))
    at = F.when(F.size(moved) > 0, iso_seconds(moved[0]["time"]))
    return p.select(*landed.drop("body").columns, F.coalesce("m.create.name", "m.pool.name").alias("name"), F.col("m.create.signer").alias("creator"), iso_seconds(F.col("m.create.time")).alias("created_sec"), num("m.pool.quote_usd").alias("market_cap_usd"), progress.alias("bonding_curve_progress"), (F.coalesce(progress >= 1, F.lit(False)) | (F.size(moved) > 0)).alias("complete"), at.alias("graduated_sec"))


# Safety -------------------------------------------------------------------------------------------------------------------------

#: Keys of a contract report that are risks when set, and how the lake names them.
CONTRACT_RISKS = {
    "is_honeypot": "honeypot",
    "cannot_buy": "cannot buy",
    "cannot_sell_all": "cannot sell all",
    "is_mintable": "mintable",
    "can_take_back_ownership": "can take back ownership",
    "owner_change_balance": "owner can change balance",
    "hidden_owner": "hidden owner",
    "selfdestruct": "self destruct",
    "external_call": "external call",
    "transfer_pausable": "transfer pausable",
    "is_blacklisted": "has blacklist",
    "is_whitelisted": "has whitelist",
    "is_anti_whale": "anti whale",
    "anti_whale_modifiable": "anti-whale modifiable",
    "slippage_modifiable": "modifiable tax",
    "personal_slippage_modifiable": "personal slippage modifiable",
    "trading_cooldown": "trading cooldown",
    "is_proxy": "proxy contract",
    "honeypot_with_same_creator": "honeypot with same creator",
}
_HOLDER = "ARRAY<STRUCT<address: STRING, percent: STRING, is_locked: STRING, tag: STRING>>"
CONTRACT = ", ".join(f"{k} STRING" for k in CONTRACT_RISKS) + f", is_open_source STRING, owner_address STRING, buy_tax STRING, sell_tax STRING, holder_count STRING, creator_percent STRING, holders {_HOLDER}, lp_holders {_HOLDER}"


def share_sum(holders: Column, n: int | None = None, where=None) -> Column:
    """Sum of percents of the first n holders (all) for which where holds; null without holders."""
    some = F.slice(holders, 1, n) if n else holders
    some = F.filter(some, where) if where else some
    total = F.aggregate(some, F.lit(0.0), lambda a, h: a + F.coalesce(C.to_number(h["percent"]), F.lit(0.0)))
    return F.when(F.size(holders) > 0, total)


def contract_safety(landed: DataFrame) -> DataFrame:
    """A contract report: flags, taxes, owner renounced (null if unknown), share of the ten first holders, liquidity locked and burned."""
    p = parsed(landed, CONTRACT)
    lp = F.col("m.lp_holders")
    burned = lambda h: F.lower(F.trim(F.coalesce(h["address"], F.lit("")))).isin(*BURN) | F.contains(F.lower(F.coalesce(h["tag"], F.lit(""))), F.lit("burn"))
    flags = flag_list([*((C.to_flag(F.col(f"m.{k}")), name) for k, name in CONTRACT_RISKS.items()), (~C.to_flag(F.col("m.is_open_source")), "not open source")])
    return p.select(
        *landed.drop("body").columns, C.to_flag(F.col("m.is_honeypot")).alias("is_honeypot"), num("m.buy_tax").alias("buy_tax"), num("m.sell_tax").alias("sell_tax"), F.when(F.col("m.owner_address").isNotNull(), F.lower(F.trim("m.owner_address")).isin("", *BURN)).alias("ownership_renounced"),
        share_sum(F.col("m.holders"), 10).alias("top10_holder_pct"), share_sum(lp, None, lambda h: C.to_flag(h["is_locked"])).alias("lp_locked_pct"), share_sum(lp, None, burned).alias("lp_burned_pct"), whole("m.holder_count").alias("holder_count"), num("m.creator_percent").alias("creator_pct"), flags.alias("flags"),
    )


_STATUS = "STRUCT<status: STRING>"
MINT = f"mintable {_STATUS}, freezable {_STATUS}, closable {_STATUS}, balance_mutable_authority {_STATUS}, metadata_mutable {_STATUS}, non_transferable STRING, transfer_hook ARRAY<STRING>, default_account_state STRING, transfer_fee STRUCT<fee_rate: STRING, current_fee_rate: STRING, pct: STRING>, creators ARRAY<STRUCT<malicious_address: STRING>>, holders {_HOLDER}, holder_count STRING, dex ARRAY<STRUCT<burn_percent: STRING>>"


def mint_safety(landed: DataFrame) -> DataFrame:
    """A mint's report: authorities, transfer fee (above 1: basis points), share of the ten first holders, most burned liquidity."""
    p = parsed(landed, MINT)
    on = lambda k: C.to_flag(F.col(f"m.{k}.status"))
    fee = C.to_number(any_of("m.transfer_fee.fee_rate", "m.transfer_fee.current_fee_rate", "m.transfer_fee.pct"))
    burn = F.array_max(F.transform("m.dex", lambda d: F.when(C.to_number(d["burn_percent"]) > 1, C.to_number(d["burn_percent"]) / 100).otherwise(C.to_number(d["burn_percent"]))))
    flags = flag_list([
        (on("mintable"), "mint authority active"), (on("freezable"), "freeze authority active"), (on("closable"), "account closable"), (on("balance_mutable_authority"), "balance mutable"), (on("metadata_mutable"), "mutable metadata"),
        (C.to_flag(F.col("m.non_transferable")), "non-transferable"), (F.size("m.transfer_hook") > 0, "transfer hook"), (whole("m.default_account_state") != 0, "default account state frozen"), (F.col("m.transfer_fee").isNotNull(), "transfer fee"),
        (F.exists("m.creators", lambda c: F.coalesce(C.to_flag(c["malicious_address"]), F.lit(False))), "malicious creator"),
    ])
    return p.select(*landed.drop("body").columns, on("mintable").alias("mint_authority_active"), on("freezable").alias("freeze_authority_active"), F.when(fee > 1, fee / 10_000).otherwise(fee).alias("transfer_tax"), share_sum(F.col("m.holders"), 10).alias("top10_holder_pct"), burn.alias("lp_burned_pct"), whole("m.holder_count").alias("holder_count"), flags.alias("flags"))


REPORT = "mintAuthority STRING, freezeAuthority STRING, score_normalised STRING, rugged BOOLEAN, totalHolders STRING, topHolders ARRAY<STRUCT<pct: STRING>>, markets ARRAY<STRUCT<lp: STRUCT<lpLockedPct: STRING>>>, transferFee STRUCT<pct: STRING>, risks ARRAY<STRUCT<name: STRING>>"


def report_safety(landed: DataFrame) -> DataFrame:
    """A report with percents: an authority that is null is revoked (false) if the report names it at all."""
    p = landed.withColumn("keys", F.json_object_keys("body")).withColumn("m", F.from_json("body", REPORT)).drop("body")
    active = lambda k: F.when(F.array_contains("keys", k), F.coalesce(F.col(f"m.{k}") != "", F.lit(False)))
    top = F.aggregate(F.slice("m.topHolders", 1, 10), F.lit(0.0), lambda a, h: a + F.coalesce(C.to_number(h["pct"]), F.lit(0.0))) / 100
    locked = F.array_max(F.transform("m.markets", lambda x: C.to_number(x["lp"]["lpLockedPct"]))) / 100
    names = F.filter(F.transform("m.risks", lambda r: r["name"]), lambda x: x.isNotNull())
    return p.select(*landed.drop("body").columns, num("m.score_normalised").alias("risk_score"), F.col("m.rugged").alias("rugged"), active("mintAuthority").alias("mint_authority_active"), active("freezeAuthority").alias("freeze_authority_active"), F.when(F.size("m.topHolders") > 0, top).alias("top10_holder_pct"), locked.alias("lp_locked_pct"), tax_fraction(F.col("m.transferFee.pct")).alias("transfer_tax"), F.coalesce(names, F.array().cast("array<string>")).alias("flags"))


SIMULATED = "summary STRUCT<flags: ARRAY<STRING>, riskLevel: STRING>, honeypotResult STRUCT<isHoneypot: BOOLEAN, honeypotReason: STRING>, simulationResult STRUCT<buyTax: STRING, sellTax: STRING, transferTax: STRING>, contractCode STRUCT<openSource: BOOLEAN, isProxy: BOOLEAN>, token STRUCT<totalHolders: STRING>"


def simulated_safety(landed: DataFrame) -> DataFrame:
    """A simulated round trip: percent taxes as fractions, the reason added to the flags once."""
    p = parsed(landed, SIMULATED)
    flags = F.coalesce("m.summary.flags", F.array().cast("array<string>"))
    reason = F.col("m.honeypotResult.honeypotReason")
    flags = F.when((reason != "") & ~F.array_contains(flags, reason), F.array_append(flags, reason)).otherwise(flags)
    return p.select(*landed.drop("body").columns, num("m.summary.riskLevel").alias("risk_score"), F.col("m.honeypotResult.isHoneypot").alias("is_honeypot"), tax_fraction(F.col("m.simulationResult.buyTax")).alias("buy_tax"), tax_fraction(F.col("m.simulationResult.sellTax")).alias("sell_tax"), F.col("m.contractCode.openSource").alias("is_open_source"), whole("m.token.totalHolders").alias("holder_count"), flags.alias("flags"))


def mint_account_safety(landed: DataFrame) -> DataFrame:
    """A mint account and its largest accounts as a node returns them: supply, authorities, share of the ten largest; flagged above one half."""
    p = parsed(landed, "info STRUCT<decimals: STRING, supply: STRING, mintAuthority: STRING, freezeAuthority: STRING>, largest ARRAY<STRUCT<uiAmount: STRING>>").where("m.info is not null")
    supply = num("m.info.supply") / F.pow(F.lit(10.0), F.coalesce(num("m.info.decimals"), F.lit(9.0)))
    ten = F.aggregate(F.slice("m.largest", 1, 10), F.lit(0.0), lambda a, x: a + F.coalesce(C.to_number(x["uiAmount"]), F.lit(0.0)))
    share = F.when((F.size("m.largest") > 0) & (supply > 0), ten / supply)
    mint, freeze = F.col("m.info.mintAuthority").isNotNull(), F.col("m.info.freezeAuthority").isNotNull()
    flags = flag_list([(mint, "mint authority active"), (freeze, "freeze authority active"), (share > 0.5, "top10 hold >50%")])
    return p.select(*landed.drop("body").columns, supply.alias("total_supply"), mint.alias("mint_authority_active"), freeze.alias("freeze_authority_active"), share.alias("top10_holder_pct"), flags.alias("flags"))


def owner_safety(calls: DataFrame, result: str = "owner_hex") -> DataFrame:
    """A contract's owner() result (a 32-byte word): owner, renounced, flag; null without a result."""
    owner = F.when(F.length(result) >= 42, F.concat(F.lit("0x"), F.lower(F.right(F.col(result), F.lit(40)))))
    gone = owner.isin(*BURN)
    return calls.select(*[c for c in calls.columns if c != result], owner.alias("owner_address"), gone.alias("ownership_renounced"), flag_list([(~gone, "ownership not renounced")]).alias("flags"))


# Listings -----------------------------------------------------------------------------------------------------------------------


def listings(tickers: DataFrame, key: str) -> DataFrame:
    """tickers(key, page, pos, identifier, name, base, target): one a venue and pair (the first); sorted distinct names of centralised and decentralised venues."""
    once = tickers.groupBy(key, "identifier", "base", "target").agg(F.min_by("name", F.struct("page", "pos")).alias("name")).where("name <> ''")
    dex = F.coalesce(C.is_dex(F.col("identifier")), F.lit(False))
    return once.groupBy(key).agg(F.count("*").alias("tickers"), F.array_sort(F.collect_set(F.when(~dex, F.col("name")))).alias("cex"), F.array_sort(F.collect_set(F.when(dex, F.col("name")))).alias("dex"))


# Output -------------------------------------------------------------------------------------------------------------------------


def as_json(rows: DataFrame, keep: list[str], name: str = "body") -> DataFrame:
    """keep and the other columns as one JSON text that any reader takes: not-a-number and infinity are left out like nulls, times are ISO in UTC, bytes hex."""
    made = []
    for column, kind in rows.dtypes:
        c = F.col(column)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind == "timestamp":
            c = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif kind == "binary":
            c = F.lower(F.hex(c))
        if column not in keep:
            made.append(c.alias(column))
    return rows.select(*keep, F.to_json(F.struct(*made)).alias(name))
