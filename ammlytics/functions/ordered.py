"""Order over all rows of a key without a task that holds them: running sums, ranks, selection and recurrences in two levels.

Rows are range-partitioned by key and order, each partition sums up what it holds, the sums of the partitions before are added. A window
spans what one partition has of a key; the second level has a row for each partition and key. The range-partitioned table is written once
(``materialised``), since borders are sampled anew each time that it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.session import materialised


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in ranges of key and order, with ``_part``, the number of its range: later rows of a key have no smaller one. Rows equal in all of them may lie in two ranges."""
    return materialised(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a running sum by key up to and with each row for each entry of ``sums`` (name: what is summed). ``order`` has to tell the rows of a key apart, or their sums depend on chance."""
    p = placed(df.withColumns({f"_x_{n}": c for n, c in sums.items()}), keys, order)
    return _added(p, keys, order, {n: f"_x_{n}" for n in sums}).drop("_part", *[f"_x_{n}" for n in sums])


def _added(p: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    w = _inside(keys, order)
    parts = p.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    up = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_s_{n}").over(up), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = p.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    on = (F.col("_part") == F.col("_p")) if not keys else [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    out = inside.join(before, on)
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_p", *[f"_k_{k}" for k in keys], *[f"_b_{n}" for n in sums])


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, c (rows with it), before (rows of the key with a smaller value), n (rows of the key): one row for each different value that isn't null.

    Equal values are one row before anything is ordered, so a value that a third of all rows have is no more than that.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    r = running(c, keys, [value], {"_to": F.col("c")})
    n = c.groupBy(*keys).agg(F.sum("c").alias("n"))
    r = r.withColumn("before", F.col("_to") - F.col("c")).drop("_to")
    if not keys:
        return r.crossJoin(F.broadcast(n))  # one row
    n = n.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n")
    return r.join(n, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "r") -> DataFrame:
    """df with the rank of its value within keys, equal values sharing the mean of their ranks; null where the value is."""
    r = counted(df, keys, value).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), (F.col("before") + (F.col("c") + 1) / 2.0).alias(name))
    on = [F.col(value) == F.col("_v"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return df.join(r, on, "left").drop("_v", *[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles named in ``at`` (name: share), interpolated between neighbours: values at places floor and ceil of share * (n - 1)."""
    v = counted(df, keys, value)

    def place(share: float, up: int) -> Column:
        x = F.lit(float(share)) * (F.col("n") - 1)
        whole = F.floor(x)
        return whole + F.when(x > whole, up).otherwise(0)

    def value_at(share: float, up: int) -> Column:
        k = place(share, up)
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.col(value)))

    ends = {f"{name}_{up}": value_at(share, up) for name, share in at.items() for up in (0, 1)}
    ends |= {f"_f_{name}": F.max(F.lit(float(share)) * (F.col("n") - 1) - place(share, 0)) for name, share in at.items()}
    g = v.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()])
    return g.select(*keys, *[(F.col(f"{n}_0") + (F.col(f"{n}_1") - F.col(f"{n}_0")) * F.col(f"_f_{n}")).alias(n) for n in at])


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value that isn't null up to and with each row of its key: within a range by a window, from the ranges before by their last values."""
    p = placed(df, keys, order)
    known = p.where(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    spans = p.select("_part", *keys).distinct().withColumnsRenamed({"_part": "_p", **{k: f"_k_{k}" for k in keys}})
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    up = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(known, same, "left").select("_p", *[f"_k_{k}" for k in keys], F.last("_last", ignorenulls=True).over(up).alias("_carry"))
    inside = p.withColumn("_in", F.last(value, ignorenulls=True).over(_inside(keys, order)))
    return inside.join(carried, same).withColumn(name, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_part", "_p", *[f"_k_{k}" for k in keys])
