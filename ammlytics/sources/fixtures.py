"""Domain tables made from the driver's tables: trades, price bars, pools, holder snapshots, transfers, liquidity events.

One SQL text for each, valid in Spark and DuckDB; plans over them are written separately for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ammlytics.session import ship

_EPOCH = "{epoch}"
CTES = {
    "trades": """SELECT CASE WHEN user_id % 3 = 0 THEN 'solana' ELSE 'bsc' END AS chain, concat('pool', CAST(user_id AS STRING)) AS pair_address,
 concat('dex', CAST(user_id % 4 AS STRING)) AS dex, {epoch} AS sec,
 CASE WHEN event_type IN ('purchase','signup') THEN 'buy' WHEN event_type IN ('view','click') THEN 'sell' END AS side,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS price_usd, value * (1 + event_id % 7) AS amount_usd,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(10000 + 100 * (event_id % 97) AS DOUBLE) END AS reserve_usd,
 concat('m', CAST(event_id % 4 AS STRING)) AS maker, CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS block_number, event_id AS log_index FROM events""",
    "bars": """SELECT pair_address, day, min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close, sum(vol) AS volume, count(*) AS n
 FROM (SELECT p_brand AS pair_address, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS px, l_extendedprice AS vol,
 row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
 FROM lineitem JOIN part ON l_partkey = p_partkey) x GROUP BY pair_address, day""",
    "pool_universe": """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'solana' ELSE 'bsc' END AS chain, concat('pool', CAST(c_custkey AS STRING)) AS pair_address,
 concat('dex', CAST(c_nationkey % 4 AS STRING)) AS dex, CAST(1701453600 + 86400 * (c_custkey % 11) AS BIGINT) AS created_sec, c_custkey AS created_block,
 concat('t', CAST(c_custkey % 7 AS STRING)) AS token0, concat('q', CAST(c_custkey % 3 AS STRING)) AS token1 FROM customer WHERE c_custkey % 2 = 0""",
    "holders": """SELECT concat('pool', CAST(o_custkey AS STRING)) AS address, CASE WHEN o_custkey % 3 = 0 THEN 'solana' ELSE 'bsc' END AS chain, o_orderdate AS observed_at, o_orderkey AS seq,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 1000 END AS holder_count, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS top10_pct FROM orders""",
    "transfers": """SELECT l_partkey % 20 AS token, CASE WHEN l_suppkey % 10 = 0 THEN '0x0' ELSE concat('a', CAST(l_suppkey AS STRING)) END AS src,
 concat('a', CAST(l_orderkey % 101 AS STRING)) AS dst, CAST(l_quantity AS BIGINT) AS value, l_orderkey AS block FROM lineitem""",
    "liquidity": """SELECT p_brand AS pool, -60 * (1 + l_linenumber) AS tick_lower, CAST(60 * (1 + l_suppkey % 5) AS INT) AS tick_upper,
 CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS dl FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "meta": """SELECT p_brand AS pair_address, concat('chain', CAST(min(p_size) % 3 AS STRING)) AS chain, sum(p_retailprice) AS reserve_usd, min(p_name) AS name, count(*) AS parts FROM part GROUP BY p_brand""",
    "pools": """SELECT p_type AS token, p_brand AS pool, concat('dex', CAST(p_size % 3 AS STRING)) AS dex, concat('chain', CAST(p_size % 2 AS STRING)) AS chain,
 p_retailprice * 100 AS reserve_usd, CAST(p_size % 4 * 5 + 5 AS BIGINT) AS fee_bps, p_partkey AS id FROM part""",
}
_DUCK = "CAST(floor(epoch(ts)) AS BIGINT)"
_SPARK = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_SPARK_TEXT = {k: v.replace(_EPOCH, _SPARK) for k, v in CTES.items()}
for _k in CTES:
    CTES[_k] = CTES[_k].replace(_EPOCH, _DUCK)
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """Driver tables and stand-ins as attributes; a file is read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._have: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in {*BASE, *CTES}:
            raise AttributeError(name)
        if name not in self._have:
            self._have[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in BASE else self.sql(_SPARK_TEXT[name])
        return self._have[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables that it names, without temporary views of the session."""
        import re

        used = [n for n in (*BASE, *CTES) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})
