"""Sharding by a Feistel permutation with cycle walking over global row numbers: a reproducible shuffle with computable places.

All rows get a global number, 0 to n - 1, in the order of their key. A Feistel network permutes the numbers: a number is a place in a grid
of a x b cells, a = ceil(sqrt(n)) and b = ceil(n / a); a round adds a keyed hash of one coordinate to the other one, modulo its side. The
grid has fewer than a cells that are no number; what lands there is permuted again until it is below n (cycle walking), which keeps the
whole a permutation. Position p is shard p mod k and slot p div k, so counts of shards are at most one apart and slots have no gap; `place`
and `row_at` compute both directions for a single row without the table.

All of it is DataFrame work. Numbers come from one range partitioning with a sort inside partitions: place in the partition plus the rows
of the partitions before it (one number a partition). The sort key ends in a running id of the scan, so that equal rows, however many,
spread over partitions; they are alike, so their order doesn't show in the result.

Rows. Null keys come first. Of equal keys the row with the smaller hash of its text comes first. A null text counts as empty. An empty table
gives an empty result. Other columns are not read by ``shard_documents`` and carried unchanged by ``shuffled``, whose own columns win
over columns of the same name. The length of a text doesn't matter: only its size, checksum and hash leave the scan.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.llm._spark import bucket_count, written

#: Pairs of rounds of the network.
PAIRS = 4
_LOW = 2**31 - 1
#: Walks after the first that stand in the plan. The grid has fewer free cells than this for n up to 4096; beyond, a longer walk has a
#: probability below n ** -31 and is an error, never a wrong place.
_WALKS = 64
#: Rows of a partition while numbering.
_ROWS = 2_000_000


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Addend below 2**30 and odd factor below 2**31 of each round."""
    words = [hashlib.sha256(f"feistel/{seed}/{i}".encode()).digest() for i in range(2 * PAIRS)]
    return [(int.from_bytes(w[:4], "big") >> 2, (int.from_bytes(w[4:8], "big") >> 1) | 1) for w in words]


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid for n rows; n below 2**60."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _spread(x: int, key: tuple[int, int]) -> int:
    """What a round adds, before the modulus: middle bits of a square. x is below 2**30."""
    y = ((x + key[0]) * key[1]) & _LOW
    return (y * y) >> 20


def _squared(y: Column) -> Column:
    return F.shiftright(y * y, 20)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of global row number ``row`` of n."""
    (a, b), keys, at = grid(n), round_keys(seed), row
    while True:
        left, right = divmod(at, b)
        for k in range(0, 2 * PAIRS, 2):
            left = (left + _spread(right, keys[k])) % a
            right = (right + _spread(left, keys[k + 1])) % b
        at = left * b + right
        if at < n:
            return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that ``place`` puts there."""
    (a, b), keys, at = grid(n), round_keys(seed), slot * shards + shard
    while True:
        left, right = divmod(at, b)
        for k in range(2 * PAIRS - 2, -1, -2):
            right = (right - _spread(left, keys[k + 1])) % b
            left = (left - _spread(right, keys[k])) % a
        at = left * b + right
        if at < n:
            return at


def permuted(rows: DataFrame, row: str, n: int, seed: int = 0, name: str = "position") -> DataFrame:
    """rows with the position of the row number in column ``row``; a chain of projections, then walks for the few outside."""
    (a, b), keys = grid(n), round_keys(seed)
    out = rows.withColumn("_left", F.expr(f"`{row}` div {b}")).withColumn("_right", F.col(row) % b)
    for k in range(0, 2 * PAIRS, 2):
        for mine, other, side, key in (("_left", "_right", a, keys[k]), ("_right", "_left", b, keys[k + 1])):
            out = out.withColumn("_y", ((F.col(other) + key[0]) * key[1]).bitwiseAND(F.lit(_LOW)))
            out = out.withColumn(mine, (F.col(mine) + _squared(F.col("_y"))) % side)
    out = out.withColumn("_at", F.col("_left") * b + F.col("_right"))
    free = a * b - n
    if free > 0:

        def again(at: Column) -> Column:
            start = F.struct(F.call_function("div", at, F.lit(b)).alias("l"), (at % b).alias("r"))
            table = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("stuv", (*keys[k], *keys[k + 1]), strict=True)]) for k in range(0, 2 * PAIRS, 2)])

            def pair(cell: Column, key: Column) -> Column:
                left = (cell["l"] + _squared(((cell["r"] + key["s"]) * key["t"]).bitwiseAND(F.lit(_LOW)))) % a
                return F.struct(left.alias("l"), ((cell["r"] + _squared(((left + key["u"]) * key["v"]).bitwiseAND(F.lit(_LOW)))) % b).alias("r"))

            return F.aggregate(table, start, pair, lambda cell: cell["l"] * b + cell["r"])

        steps = F.sequence(F.lit(1), F.lit(min(free, _WALKS)))
        walked = F.aggregate(steps, F.col("_at"), lambda at, _: F.when(at >= n, again(at)).otherwise(at))
        out = out.withColumn("_at", F.when(F.col("_at") >= n, walked).otherwise(F.col("_at")))
        if free > _WALKS:
            lost = F.raise_error(F.lit(f"a walk of more than {_WALKS} steps: take another seed")).cast("long")
            out = out.withColumn("_at", F.when(F.col("_at") >= n, lost).otherwise(F.col("_at")))
    return out.withColumn(name, F.col("_at")).drop("_left", "_right", "_y", "_at")


def numbered(rows: DataFrame, *order: str, name: str = "row") -> tuple[DataFrame, int]:
    """rows, a written table, with global numbers from 0 in the given order, and their count."""
    spark = rows.sparkSession
    base = written(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [*order, "_tie"]
    dealt = base.repartitionByRange(bucket_count(spark, base.count(), _ROWS), *keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).count()  # a row a partition: small enough for one window and a broadcast
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    out = placed.withColumn("_part", part).join(offsets, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).drop("_part", "_before", "_at"), placed.count()


def _dealt(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    out = permuted(rows, "row", n, seed)
    return out.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}")).drop("position")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, row, shard, slot of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    rows, n = numbered(narrow, "doc_id", "_hash", "size", "text_crc32")
    return _dealt(rows.drop("_hash"), n, shards, seed)


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Whole rows with row, shard and slot, for ``write_shards``."""
    taken = docs.drop("row", "shard", "slot").withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows, n = numbered(taken, "doc_id", "_hash")
    return _dealt(rows.drop("_hash"), n, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0) -> None:
    """Shards as folders ``shard=``, each in files of consecutive slots in order; a reader that wants slot s opens one file."""
    spark = docs.sparkSession
    rows = shuffled(docs, shards, seed)
    n = max(shards, bucket_count(spark, rows.count(), _ROWS // 10))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle_sql(shards: int = 16, seed: int = 0) -> str:
    """DuckDB text of the same rows; doc_id is unique there."""
    keys = round_keys(seed)
    inner = "SELECT row, n, a, b, p // b AS x, p % b AS y FROM {0}"
    for k in range(0, 2 * PAIRS, 2):
        for mine, other, side, (add, factor) in (("x", "y", "a", keys[k]), ("y", "x", "b", keys[k + 1])):
            kept = f"({mine} + ((h * h) >> 20)) % {side} AS {mine}, {other}"
            inner = f"SELECT row, n, a, b, {kept} FROM (SELECT *, (({other} + {add}) * {factor}) & {_LOW} AS h FROM ({inner}))"
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
s AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)),
w AS (
  SELECT row, n, a, b, x * b + y AS p FROM ({inner.format("(SELECT row, n, a, b, row AS p FROM d, s)")})
  UNION ALL SELECT row, n, a, b, x * b + y AS p FROM ({inner.format("(SELECT * FROM w WHERE p >= n)")})
), h AS (SELECT doc_id, octet_length(encode(text)) AS len, hex(encode(text)) AS hex, row FROM d),
c AS (
  SELECT doc_id, len, row, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex, '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1]), 4294967295)) AS crc FROM h, t
)
SELECT doc_id, CAST(len + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM c JOIN w USING (row) WHERE p < n
"""
