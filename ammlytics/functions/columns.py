"""Column builders: execution cost, impact, ticks, impermanent loss, lenient coercions, classifications. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Swap fees in basis points by part of the venue's name, first hit in this order.
FEE_BPS = [
    ("pancakeswap-v3", 25.0),
    ("pancakeswap_v3", 25.0),
    ("pancakeswap", 25.0),
    ("uniswap_v3", 30.0),
    ("uniswap-v3", 30.0),
    ("uniswap", 30.0),
    ("biswap", 10.0),
    ("sushiswap", 30.0),
    ("raydium", 25.0),
    ("orca", 30.0),
    ("whirlpool", 30.0),
    ("meteora", 20.0),
    ("pumpswap", 25.0),
    ("fluxbeam", 30.0),
]
DEFAULT_FEE_BPS = 30.0
# Flat gas in USD by chain, gas units by venue, gas and native price by chain of the studies.
FLAT_GAS_USD = {"bsc": 0.30, "solana": 0.02}
GAS_UNITS = {"pancakeswap-v2": 110_000.0, "pancakeswap-v3": 140_000.0, "uniswap-v3": 140_000.0}
DEFAULT_GAS_UNITS = 120_000.0
GAS_USD = {"bsc": 0.2, "base": 0.02, "eth": 3.0, "arbitrum": 0.05, "avax": 0.05, "polygon_pos": 0.01, "sui-network": 0.01, "solana": 0.02, "tron": 0.01}
NATIVE_USD = {"bsc": 640.0, "base": 3500.0, "eth": 3500.0, "arbitrum": 3500.0, "avax": 35.0, "polygon_pos": 0.5, "sui-network": 3.5, "solana": 180.0, "tron": 0.3}
# Venue names of large centralised exchanges; names and parts of names of decentralised ones; majors and stables.
MAJOR_CEX = ("binance", "binanceus", "binance_us", "coinbase_exchange", "gdax", "coinbase", "okex", "okx", "bybit_spot", "bybit", "kraken", "upbit", "kucoin", "gate", "bitget", "htx", "huobi", "mxc", "mexc", "bitfinex", "crypto_com", "cryptocom", "bitstamp", "gemini", "bithumb")
DEX_NAMES = ("uniswap_v2", "uniswap_v3", "uniswap-v4", "pancakeswap_new", "pancakeswap-v3-bsc", "pancakeswap_v3_bsc", "sushiswap", "raydium", "raydium2", "orca", "meteora", "curve", "balancer", "jupiter", "gmx", "trader_joe", "quickswap", "aerodrome-base")
DEX_WORDS = ("swap", "dex", "_v2", "_v3", "amm", "raydium", "orca", "meteora", "uniswap", "pancake", "sushi", "curve")
MAJOR_NAMES = ("USDC", "USDT", "DAI", "USD", "WBTC", "CBBTC", "TBTC", "BTCB", "WETH", "WEETH", "WSTETH", "STETH", "RETH", "CBETH", "EZETH", "FRAX", "BUSD", "TUSD", "USDE", "SUSDE", "WBNB", "WMATIC", "WAVAX", "WFTM", "WSOL", "PYUSD", "LUSD", "GUSD", "RLUSD", "USDD", "FDUSD", "CRVUSD", "GHO", "USR", "SCRVUSD", "WBETH", "SFRXETH", "OETH", "MSOL", "JITOSOL")
IMPACT_FLOOR = 0.0002


def num(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_map(key: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def swap_fee_bps(dex: Column, table: Sequence[tuple[str, float]] = FEE_BPS, default: float = DEFAULT_FEE_BPS) -> Column:
    """Fee of the first name in order that dex contains; the default where none does or dex is null."""
    out = F.when(F.lower(dex).contains(table[0][0]), F.lit(table[0][1]))
    for name, fee in table[1:]:
        out = out.when(F.lower(dex).contains(name), F.lit(fee))
    return out.otherwise(F.lit(default))


def gas_cost_usd(chain: Column, native_usd: Column, dex: Column | None = None, native: Column | None = None, units: Column | None = None, gwei: Column | None = None) -> Column:
    """Gas of a swap: native gas paid times its price; on bsc else units x gwei x 1e-9 x price; else a flat figure (0.10 for an unknown chain)."""
    default = by_map(dex, GAS_UNITS, DEFAULT_GAS_UNITS) if dex is not None else F.lit(DEFAULT_GAS_UNITS)
    modelled = F.coalesce(units, default) if units is not None else default
    price = F.coalesce(gwei, F.lit(1.0)) if gwei is not None else F.lit(1.0)
    flat = by_map(chain, FLAT_GAS_USD, 0.10)
    out = F.when((chain == "bsc") & native_usd.isNotNull(), modelled * price * 1e-9 * native_usd).otherwise(flat)
    return out if native is None else F.coalesce(native * native_usd, out)


def price_impact(side: Column, size: Column, reserve: Column) -> Column:
    """Of a constant-product pool, half of whose reserve is the quote side: buy x, sell x / (1 + x). 1 where the reserve is missing."""
    x = size / (reserve / 2)
    return F.when(reserve.isNull() | (reserve <= 0), F.lit(1.0)).otherwise(F.when(side == "buy", x).otherwise(x / (1 + x)))


def leg_cost(side: Column, mid: Column, size: Column, reserve: Column, fee_bps: Column, gas: Column) -> Column:
    """Struct impact, fee, gas, total (fractions of size) and execution price."""
    impact = F.greatest(price_impact(side, size, reserve), F.lit(IMPACT_FLOOR))
    fee, g = fee_bps / 10_000, gas / size
    total = impact + fee + g
    return F.struct(impact.alias("impact"), fee.alias("fee"), g.alias("gas"), total.alias("total"), (mid * F.when(side == "buy", 1 + total).otherwise(1 - total)).alias("exec_price"))


def round_trip_cost(size: Column, reserve: Column, fee_bps: Column, gas: Column) -> Column:
    """Impact and fee of a buy and a sell, and gas twice, as a fraction of size."""
    buy = F.greatest(price_impact(F.lit("buy"), size, reserve), F.lit(IMPACT_FLOOR))
    sell = F.greatest(price_impact(F.lit("sell"), size, reserve), F.lit(IMPACT_FLOOR))
    return buy + sell + 2 * fee_bps / 10_000 + 2 * gas / size


def study_cost(chain: Column, reserve: Column, share: float = 0.0025, missing: float | None = 0.05) -> Column:
    """Round trip of max(50, share of the reserve) at 30 basis points and the chain's gas; ``missing`` without a reserve."""
    size = F.greatest(F.lit(50.0), share * reserve)
    return F.when(reserve.isNull() | (reserve <= 0), F.lit(missing).cast("double")).otherwise(round_trip_cost(size, reserve, F.lit(30.0), by_map(chain, GAS_USD, 0.05)))


def depth_cost(size: Column, reserve: Column, fee_bps: Column, gas: Column, depth: float, stale_bp: float) -> Column:
    """Round trip with a one-sided depth of depth x reserve and stale_bp more a leg."""
    x = size / (depth * reserve)
    return F.greatest(x, F.lit(IMPACT_FLOOR)) + F.greatest(x / (1 + x), F.lit(IMPACT_FLOOR)) + 2 * fee_bps / 10_000 + 2 * gas / size + 2 * stale_bp / 10_000


def marginal_price(side: Column, mid: Column, filled: Column, depth: Column, fee_bps: Column) -> Column:
    f = fee_bps / 10_000
    return F.when(side == "buy", mid * (1 + filled / depth) / (1 - f)).otherwise(mid * (1 - filled / depth) * (1 - f))


def sqrt_price_of_tick(tick: Column) -> Column:
    return F.pow(F.lit(1.0001), tick / 2)


def tick_of_sqrt_price(root: Column) -> Column:
    return F.floor(2 * F.log(root) / F.lit(math.log(1.0001)) + 1e-9)


def impermanent_loss(ratio: Column) -> Column:
    return 2 * F.sqrt(ratio) / (1 + ratio) - 1


def concentration(band: Column) -> Column:
    return 1 / (1 - F.sqrt(1 / (1 + band)))


def mev_pad(base: Column, share: Column, severity: Column) -> Column:
    return F.greatest(base, F.coalesce(share * severity, F.lit(0.0)))


def profit_factor(gains: Column, losses: Column) -> Column:
    """gains / |losses|; infinity without losses, 0 without either. losses: a sum of what is negative."""
    return F.when(losses < 0, gains / -losses).when(gains > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def to_number(x: Column) -> Column:
    return F.nullif(x.try_cast("double"), F.lit(float("nan")))


def to_fraction(x: Column) -> Column:
    """A number, percent over 1 divided by 100, within 0 and 1; null if it is none."""
    v = to_number(x)
    return F.when(v.isNotNull(), F.least(F.greatest(F.when(v > 1, v / 100).otherwise(v), F.lit(0.0)), F.lit(1.0)))


def to_flag(x: Column) -> Column:
    s = F.lower(F.trim(x))
    return F.when(s.isin("1", "true", "yes"), True).when(s.isin("0", "false", "no"), False)


def is_evm(chain: Column) -> Column:
    return chain != "solana"


def normal_address(chain: Column, address: Column) -> Column:
    """EVM addresses in lower case, base58 ones as they are."""
    return F.when(is_evm(chain), F.lower(address)).otherwise(address)


def coin_side(token0: Column, token1: Column, quotes: Sequence[str]) -> Column:
    """The side that is no quote; token0 if both or neither are."""
    q0, q1 = token0.isin(*quotes), token1.isin(*quotes)
    return F.when(q0 & ~q1, token1).otherwise(token0)


def venue_verdict(base: Column, venues: Column, majors: Sequence[str], cex: Sequence[str] = MAJOR_CEX) -> Column:
    return F.when(base.isin(*majors), "major_pair").when(F.arrays_overlap(venues, F.array(*[F.lit(v) for v in cex])), "major_cex").otherwise("dex_only")


def is_dex(venue: Column, names: Sequence[str] = DEX_NAMES, words: Sequence[str] = DEX_WORDS) -> Column:
    """A known name, or a name with one of the parts."""
    out = F.lower(venue).isin(*names)
    for w in words:
        out = out | F.lower(venue).contains(w)
    return out


def excluded_name(name: Column, words: Sequence[str] = MAJOR_NAMES, exact: bool = False) -> Column:
    """Does the base symbol (first word before '/') equal or begin with a word? A null name is not excluded."""
    symbol = F.substring_index(F.upper(F.trim(F.substring_index(name, "/", 1))), " ", 1)
    out = F.lit(False)
    for w in words:
        out = out | (symbol == w if exact else symbol.startswith(w))
    return F.coalesce(out, F.lit(False))
