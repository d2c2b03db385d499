"""Window helpers: rolling aggregates with a warm-up, average ranks, permutations by hash, as-of values, folds over ordered arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ammlytics.functions.ordered import last_known


def series(*keys: str, by: str = "day") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def rolling(agg, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null until ``least`` (n) non-null values are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def lagged(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


def pct_change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x / F.nullif(F.lag(x, n).over(w), F.lit(0.0)) - 1


def rsi(close: Column, w: WindowSpec, n: int) -> Column:
    """100 - 100 / (1 + mean gain / mean loss) over n rows, the first change 0; null without losses. close must be a plain column for nested windows: call on a frame with ``chg``."""
    gain, loss = F.greatest(close, F.lit(0.0)), F.greatest(-close, F.lit(0.0))
    g, d = rolling(F.avg, gain, w, n), rolling(F.avg, loss, w, n)
    return F.when(d > 0, 100 - 100 / (1 + g / d))


def ema(df: DataFrame, keys: list[str], by: str, value: str, span: int, name: str) -> DataFrame:
    """Exponential mean with a = 2 / (span + 1), seeded by the first value; ``by`` counts the rows of a key from 0, values aren't null.

    A series is cut into blocks of at most 256 rows. Inside a block the mean is a running sum of values weighted by powers of 1 - a; what
    comes in is the mean at the end of the block before, which is a sum over the last few blocks' own sums (what is older weighs less than
    1e-20). So a series of any length is many groups, and what a key's task sees is a row a block.
    """
    a = 2.0 / (span + 1)
    q = 1 - a
    rows = df.select(*keys, by, value)
    if q <= 0:
        return rows.withColumn(name, F.col(value).cast("double"))
    fall = -math.log(q)
    size = max(1, min(256, int(345 / fall)))  # powers stay below 1e150
    last = max(1, math.ceil(46 / (size * fall)))
    at = F.col(by) % size
    x = rows.withColumn("_b", F.floor(F.col(by) / size)).withColumn("_w", F.when(F.col(by) == 0, 1.0).otherwise(a) * F.col(value))
    w = Window.partitionBy(*keys, "_b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_e", F.sum(F.col("_w") * F.exp(at * fall)).over(w) * F.exp(-at * fall))
    own = x.groupBy(*keys, "_b").agg(F.sum(F.col("_w") * F.exp((at - (size - 1)) * fall)).alias("_o"))  # at the end of a full block
    before = F.collect_list("_o").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(-last, -1))
    carry = own.select(*keys, "_b", F.aggregate(before, F.lit(0.0), lambda acc, o: acc * math.exp(-size * fall) + o).alias("_c"))
    out = x.join(carry, [*keys, "_b"])
    return out.select(*keys, by, value, (F.col("_e") + F.col("_c") * F.exp(-(at + 1) * fall)).alias(name))


def quotient(x: Column, y: Column) -> Column:
    """x / y as doubles divide: an infinity where only y is 0, NaN where both are (the built-in one raises there in ANSI mode)."""
    return F.when(y == 0, x * F.lit(float("inf"))).otherwise(x / y)


def ordered_sum(x: Column, by: Column) -> Column:
    """Sum of a group in order of ``by``, to the last bit the same for the same rows; null without a value. The group is one array."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(by.alias("by"), x.alias("x")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["x"]))


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank within keys, equal values sharing the mean of their ranks; null values have none."""
    w = Window.partitionBy(*keys).orderBy(x)
    ties = Window.partitionBy(*keys, x)
    present = F.sum(F.when(x.isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys))
    return F.when(x.isNotNull(), F.rank().over(w) - present + (F.count(x).over(ties) - 1) / 2.0)


def hash_order(seed: str, *parts: Column) -> Column:
    """A sort key that is a seeded permutation: md5 of seed and parts, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, tie: str | None = None) -> DataFrame:
    """left with the last non-null ``value`` of right at or before its time: one union in order of time, in two levels (no range join, no window over a whole key).

    tie: column of right that orders rows of one time; the largest is last.
    """
    order = F.col(tie) if tie else F.lit(0)
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_o"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), order.alias("_o"))
    both = last_known(l.unionByName(r, allowMissingColumns=True), keys, ["_t", "_side", "_o"], "_v", f"{value}_as_of")
    return both.where("_side = 1").drop("_t", "_side", "_v", "_o")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of a group; null where either side doesn't vary (the built-in one raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
