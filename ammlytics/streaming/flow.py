"""Structured Streaming: launch messages, live bars, resumable ingest of event files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammlytics.functions.ordered import running
from ammlytics.sources.lake import exists

LAUNCH = "mint STRING, txType STRING, name STRING, symbol STRING, pool STRING, message STRING, vSolInBondingCurve DOUBLE, vTokensInBondingCurve DOUBLE, marketCapSol DOUBLE, traderPublicKey STRING"


def launch_kind(m: Column) -> Column:
    """migrate, create, or null: acknowledgements and messages without a mint are neither."""
    kind = F.lower(F.coalesce(m["txType"], F.lit("")))
    migrate = (kind == "migrate") | (m["pool"].isNotNull() & m["name"].isNull() & (kind != "create"))
    create = (kind == "create") | m["vSolInBondingCurve"].isNotNull() | m["vTokensInBondingCurve"].isNotNull()
    return F.when(m["mint"].isNull() | m["message"].isNotNull(), None).when(migrate, "migrate").when(create, "create")


def launches(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as launch records with their kind; batch or stream."""
    x = messages.withColumn("m", F.from_json(F.col(column).cast("string"), LAUNCH)).withColumn("kind", launch_kind(F.col("m"))).where("kind is not null")
    return x.select("kind", F.col("m.mint").alias("mint"), F.col("m.name").alias("name"), F.col("m.symbol").alias("symbol"), F.col("m.pool").alias("migrated_pool"), F.col("m.vSolInBondingCurve").alias("virtual_sol"), F.col("m.vTokensInBondingCurve").alias("virtual_tokens"), F.col("m.traderPublicKey").alias("creator"))


def live_bars(trades: DataFrame, width: str, late: str, time: str = "ts") -> DataFrame:
    """Bars by event-time window with a watermark: first and last price by time, extremes, volume, count. Equal to the batch bars in complete mode."""
    t = trades.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width), "pair_address").agg(
        F.min_by("price_usd", F.struct(time, "log_index")).alias("open"), F.max("price_usd").alias("high"), F.min("price_usd").alias("low"), F.max_by("price_usd", F.struct(time, "log_index")).alias("close"), F.sum("amount_usd").alias("volume"), F.count("*").alias("n_trades")
    )


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], *, time: str | None = None, late: str = "1 day"):
    """Appends new rows once and stops: all files that came since the checkpoint, repeated deliveries of a key dropped (within ``late`` of each other if a time column is named)."""
    if time is None:
        rows = stream.dropDuplicates(keys)
    else:
        rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class BoundedCollection:
    """Rows of a stream handed out in portions, none lost and none twice, whatever is killed when.

    Every batch is stored as it came, under its number, so that a replayed batch overwrites itself. Stored rows have a place: batch, then
    order in the batch. A run hands out the next places, written under the run's number; only then the ledger notes how far it went. What
    is beyond a run's bound stays stored for the next one, which takes it before it waits for the stream; a run that died is
    written anew under its number.
    """

    def __init__(self, stream: DataFrame, target: str, checkpoint: str, skip: Column | None = None):
        self.spark, self.stream, self.target, self.skip = stream.sparkSession, stream, target, skip
        self.offsets, self.store, self.ledger = (f"{checkpoint}/{x}" for x in ("offsets", "arrived", "ledger"))

    def _batches(self) -> dict[int, int]:
        """Rows of each stored batch."""
        if not exists(self.spark, self.store):
            return {}
        return {r["batch"]: r["count"] for r in self._stored().groupBy("batch").count().collect()}  # a row a batch

    def _stored(self) -> DataFrame:
        kinds = "".join(f"`{n}` {k}, " for n, k in self.stream.dtypes)
        return self.spark.read.schema(f"{kinds}_at long, batch long").parquet(self.store)

    def handed_out(self) -> tuple[int, int]:
        """Runs that ended and rows that they handed out, together."""
        if not exists(self.spark, self.ledger):
            return 0, 0
        r = self.spark.read.schema("run long, upto long").parquet(self.ledger).agg(F.count("*"), F.max("upto")).first()
        return r[0], r[1] or 0

    def _arrived(self, batch: DataFrame, number: int) -> None:
        rows = batch if self.skip is None else batch.where(~F.coalesce(self.skip, F.lit(False)))
        rows.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.store}/batch={number}")

    def receive(self, enough: int, seconds: float) -> int:
        """Stores batches until so many rows are stored, or so long; how many there are."""
        have = sum(self._batches().values())
        if have >= enough:
            return have
        query = self.stream.writeStream.foreachBatch(self._arrived).option("checkpointLocation", self.offsets).trigger(processingTime="1 second").start()
        try:
            until = time.monotonic() + seconds
            while have < enough and time.monotonic() < until and not query.awaitTermination(1):
                have = sum(self._batches().values())
        finally:
            query.stop()
        return sum(self._batches().values())

    def hand_out(self, most: int) -> int:
        """The next ``most`` stored rows as a run of the target; how many there were."""
        run, given = self.handed_out()
        counts, before, start = self._batches(), {}, 0
        for number in sorted(counts):
            before[number] = start
            start += counts[number]
        upto = min(start, given + most)
        wanted = [n for n in before if before[n] < upto and before[n] + counts[n] > given]
        if wanted:
            first = before[min(wanted)]
            rows = running(self._stored().where(F.col("batch").isin(wanted)), [], ["batch", "_at"], {"_place": F.lit(1)})
            rows = rows.where((F.col("_place") + first > given) & (F.col("_place") + first <= upto))
            rows.drop("_place", "_at", "batch").write.mode("overwrite").parquet(f"{self.target}/run={run}")
            self._note(run, upto)
        return upto - given

    def _note(self, run: int, upto: int) -> None:
        self.spark.createDataFrame([(run, upto)], "run long, upto long").coalesce(1).write.mode("append").parquet(self.ledger)


def collect_bounded(stream: DataFrame, target: str, checkpoint: str, *, most: int, seconds: float, skip: Column | None = None) -> int:
    """Appends at most ``most`` rows of a stream (those for which skip holds aren't counted) as a run of the target, or what came in so many seconds; returns how many. The rest waits for the next call."""
    c = BoundedCollection(stream, target, checkpoint, skip)
    c.receive(c.handed_out()[1] + most, seconds)
    return c.hand_out(most)
