"""How well a score ranks names day by day: rank correlation, its distribution under permuted labels, what each feature adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ammlytics.functions.ordered import quantiles
from ammlytics.functions.rolling import average_rank, hash_order
from ammlytics.session import materialised


def _centred(rows: DataFrame, day: list[str], column: str) -> Column:
    return average_rank(F.col(column), day) - (F.count(column).over(Window.partitionBy(*day)) + 1) / 2.0


def _days(x: DataFrame, day: list[str], least: int) -> DataFrame:
    """day, n, norm, ic of the days with ``least`` names on which both sides vary; x has centred ranks p and q."""
    norm = F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))
    d = x.groupBy(*day).agg(F.count("*").alias("n"), norm.alias("norm"), F.sum(F.col("p") * F.col("q")).alias("pq"))
    return d.where((F.col("n") >= least) & (F.round("norm", 9) > 0)).select(*day, "n", "norm", (F.col("pq") / F.col("norm")).alias("ic"))


def permutation_distribution(rows: DataFrame, keys: list[str], date: str, name: str, score: str, y: str, *, seeds: int = 200, least: int = 5) -> DataFrame:
    """keys, days, ic (mean over days), null_mean, null_sd, null_p95, z, p of the mean rank correlation of score and y among ``seeds`` permutations of the names' y within each day.

    Ranks are made once. A permutation gives each name the y of the name at the place that its hash has in the day's order, so a
    seed costs one more row a name and a join of places; no label is shuffled and no model fitted anew. Rows without score or y take no
    part. p = (1 + permutations that do as well) / (seeds + 1). Without such days there is no row.
    """
    day = [*keys, date]
    x = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*day, name, score, y)
    x = materialised(x.select(*day, name, _centred(x, day, score).alias("p"), _centred(x, day, y).alias("q"), F.row_number().over(Window.partitionBy(*day).orderBy(name)).alias("a")))
    days = materialised(_days(x, day, least))
    drawn = x.join(days.select(*day), day, "left_semi").select(*day, name, "p", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    order = [hash_order("perm", F.col("seed"), F.col(date), F.col(name)), F.col(name)]
    drawn = drawn.select(*day, "seed", "p", F.row_number().over(Window.partitionBy(*day, "seed").orderBy(*order)).alias("a"))
    null = drawn.join(x.select(*day, "a", "q"), [*day, "a"]).groupBy(*day, "seed").agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    null = null.join(days, day).groupBy(*keys, "seed").agg(F.avg(F.col("pq") / F.col("norm")).alias("ic0"))
    null = materialised(null)
    real = days.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("ic").alias("ic"))
    both = null.join(real, keys) if keys else null.join(F.broadcast(real))  # one row
    told = both.groupBy(*keys).agg(F.first("days").alias("days"), F.first("ic").alias("ic"), F.avg("ic0").alias("null_mean"), F.stddev_pop("ic0").alias("null_sd"), ((1 + F.count_if(F.round("ic0", 9) >= F.round("ic", 9))) / F.lit(seeds + 1.0)).alias("p"))
    q = quantiles(null, keys, "ic0", {"null_p95": 0.95})
    told = told.join(q, keys) if keys else told.join(F.broadcast(q))  # one row
    return told.where("days > 0").withColumn("z", F.try_divide(F.col("ic") - F.col("null_mean"), F.when(F.round("null_sd", 12) > 0, F.col("null_sd"))))


def mean_ic(rows: DataFrame, keys: list[str], date: str, score: str, y: str, least: int = 5) -> DataFrame:
    """keys, days, ic: the mean over days of the rank correlation."""
    day = [*keys, date]
    x = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*day, score, y)
    x = x.select(*day, _centred(x, day, score).alias("p"), _centred(x, day, y).alias("q"))
    return _days(x, day, least).groupBy(*keys).agg(F.count("*").alias("days"), F.avg("ic").alias("ic"))


def with_each_shuffled(rows: DataFrame, features: list[str], date: str, name: str, seed: str = "drop") -> DataFrame:
    """rows once as they are (variant '') and once for each feature (its name) with that feature's values permuted among the names of each day."""
    place = F.row_number().over(Window.partitionBy(date).orderBy(name))
    x = materialised(rows.withColumn("_a", place))
    variants = F.explode(F.array(F.lit(""), *[F.lit(f) for f in features])).alias("variant")
    wide = x.select("*", variants)
    order = [hash_order(seed, F.col("variant"), F.col(date), F.col(name)), F.col(name)]
    wide = wide.withColumn("_b", F.row_number().over(Window.partitionBy(date, "variant").orderBy(*order)))
    given = x.select(F.col(date).alias("_d"), F.col("_a").alias("_p"), *[F.col(f).alias(f"_g_{f}") for f in features])
    y = wide.join(given, (F.col(date) == F.col("_d")) & (F.col("_b") == F.col("_p")))
    kept = {f: F.when(F.col("variant") == f, F.col(f"_g_{f}")).otherwise(F.col(f)) for f in features}
    return y.withColumns(kept).drop("_a", "_b", "_d", "_p", *[f"_g_{f}" for f in features])
