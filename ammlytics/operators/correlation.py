"""Correlations of many streams in blocks: their squares' sum and the exact median of their absolute values, with no row for a pair of streams.

Streams are numbered and packed, a block of 256 to a row of standardised days (a missing day is a return of 0). A task multiplies two
blocks and emits sums: of squares, and counts of absolute values by bins. The median is found by narrowing the bins around its place until
what lies between is few enough to be looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions.ordered import running
from ammlytics.session import materialised, ship

SIZE, BINS, FEW = 256, 1024, 100_000


def packed(returns: DataFrame, stream: str, date: str, value: str, least: int = 3) -> tuple[DataFrame, int, int]:
    """Blocks (block, n, body), the number of streams and of days. Streams with fewer rows or without variance have none. Rows of a stream and day add up."""
    spark = returns.sparkSession
    ship(spark)
    x = returns.groupBy(stream, date).agg(F.sum(value).alias("r"))
    days = x.select(date).distinct().withColumn("t", F.row_number().over(Window.orderBy(date)) - 1)  # a row a day
    days = materialised(days)
    d = days.count()
    s = x.groupBy(stream).agg((F.sum("r") / d).alias("m"), (F.sum(F.col("r") * F.col("r")) / d).alias("q"), F.count("*").alias("c")) if d else x.groupBy(stream).agg(F.lit(0.0).alias("m"), F.lit(0.0).alias("q"), F.count("*").alias("c"))
    s = s.withColumn("v", F.col("q") - F.col("m") * F.col("m")).where((F.col("c") >= least) & (F.col("v") > 1e-18)).select(stream, "m", F.sqrt("v").alias("sd"))
    s = materialised(running(s, [], [stream], {"k": F.lit(1)}).select(stream, "m", "sd", F.floor((F.col("k") - 1) / SIZE).cast("int").alias("block"), ((F.col("k") - 1) % SIZE).cast("int").alias("place")))
    rows = x.join(s, stream).join(F.broadcast(days), date).select("block", "place", "t", "r", "m", "sd")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.drop_duplicates("place").sort_values("place")
        z = np.zeros((len(own), d))
        at = {p: i for i, p in enumerate(own["place"])}
        z[[at[p] for p in frame["place"]], frame["t"]] = frame["r"]
        z = (z - own["m"].to_numpy()[:, None]) / own["sd"].to_numpy()[:, None]
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "n": [len(own)], "body": [z.tobytes()]})

    return materialised(rows.groupBy("block").applyInPandas(pack, "block int, n int, body binary")), s.count(), d


def _over_pairs(blocks: DataFrame, d: int, told: Callable[[np.ndarray], list[tuple[str, int, float]]]) -> DataFrame:
    """(kind, place, value) that ``told`` gives of the correlations of each two blocks, a pair of streams once."""
    last = blocks.agg(F.max("block").alias("last"))
    left = blocks.join(F.broadcast(last)).select(F.col("block").alias("a"), F.col("n").alias("na"), F.col("body").alias("za"), F.explode(F.sequence("block", "last")).alias("b"))  # one row
    pairs = left.join(blocks.select(F.col("block").alias("b"), F.col("n").alias("nb"), F.col("body").alias("zb")), "b")

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        za, zb = np.frombuffer(r["za"]).reshape(r["na"], d), np.frombuffer(r["zb"]).reshape(r["nb"], d)
        c = za @ zb.T / d
        c = c[np.triu_indices(len(c), 1)] if r["a"] == r["b"] else c.ravel()
        return pd.DataFrame(told(c), columns=["kind", "place", "value"])

    return pairs.groupBy("a", "b").applyInPandas(multiply, "kind string, place int, value double")


def participation(returns: DataFrame, stream: str, date: str, value: str, least: int = 3) -> tuple[int, float | None, float | None]:
    """Number of streams, n^2 / sum of all squared correlations, median absolute correlation of pairs (None without pairs)."""
    blocks, n, d = packed(returns, stream, date, value, least)
    pairs = n * (n - 1) // 2
    if not pairs:
        return n, float(n) if n else None, None
    squares = _over_pairs(blocks, d, lambda c: [("q", 0, float((c * c).sum()))]).agg(F.sum("value")).first()[0]
    low, width, below = 0.0, 1.0 + 1e-9, 0  # what is looked at: width from low on, with so many values below
    places = sorted({(pairs - 1) // 2, pairs // 2})
    inside = pairs
    while inside > FEW and width > 1e-15:

        def counts(c: np.ndarray, low: float = low, width: float = width) -> list[tuple[str, int, float]]:
            at = np.floor((np.abs(c) - low) / width * BINS)
            found = np.bincount(at[(at >= 0) & (at < BINS)].astype(int), minlength=BINS)
            return [("h", k, float(v)) for k, v in enumerate(found) if v]

        table = {r["place"]: int(r["n"]) for r in _over_pairs(blocks, d, counts).groupBy("place").agg(F.sum("value").alias("n")).collect()}  # BINS rows
        sums = np.concatenate([[0], np.cumsum([table.get(k, 0) for k in range(BINS)])]) + below
        first, final = (int(np.searchsorted(sums, p, side="right")) - 1 for p in (places[0], places[-1]))
        low, below, inside = low + width / BINS * first, int(sums[first]), int(sums[final + 1] - sums[first])
        if final > first and inside > FEW:
            break  # two neighbours in two full bins: their values are the bins' ends, to within a bin
        width = width / BINS * (final - first + 1)
    if inside > FEW:
        return n, n * n / (n + 2 * squares), low

    def values(c: np.ndarray) -> list[tuple[str, int, float]]:
        a = np.abs(c)
        return [("v", 0, float(v)) for v in a[(a >= low) & (a < low + width)]]

    found = sorted(r["value"] for r in _over_pairs(blocks, d, values).collect())  # FEW at most
    return n, n * n / (n + 2 * squares), sum(found[p - below] for p in places) / len(places)
