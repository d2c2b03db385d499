"""Lake round trips and streams against their batch twins."""

from pyspark.sql import functions as F

from ammlytics.operators import market
from ammlytics.sources import lake
from ammlytics.sources.fixtures import Tables
from ammlytics.streaming import flow


def test_lake_round_trip(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("bsc", "p1", 5, 1.0), (None, "p2", 6, None)], "chain string, pair_address string, holder_count long, top10_pct double")
    rows = rows.select("chain", F.col("pair_address").alias("address"), "holder_count", "top10_pct").withColumn("observed_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    lake.write(rows, root, "holders", "observed_at")
    lake.write(rows, root, "other")
    got = lake.read(spark, root, "holders", ["chain", "address", "dt"]).collect()
    assert {(r.chain, r.address, str(r.dt)) for r in got} == {("bsc", "p1", "2024-01-02"), ("unknown", "p2", "2024-01-02")}
    assert lake.read(spark, root, "trades").count() == 0
    assert [(r.name, r.rows) for r in lake.tables(spark, root).collect()] == [("holders", 2), ("other", 2)]
    assert spark.sql("select count(*) c from holders where chain = 'bsc'").first().c == 1


def test_json_last_record_wins(spark, tmp_path):
    path = tmp_path / "u.jsonl"
    path.write_text('{"pair": "a", "x": 1}\n{"pair": "a", "x": 2}\n{"pair": "b", "x": 3}\n')
    got = lake.json_universe(spark, str(path), "pair string, x int", "pair").collect()
    assert {(r.pair, r.x) for r in got} == {("a", 2), ("b", 3)}


def test_launch_messages(spark):
    rows = ['{"message": "ok"}', '{"mint": "m1", "txType": "create", "name": "n"}', '{"mint": "m2", "pool": "x"}', '{"mint": "m3", "vSolInBondingCurve": 3.0, "name": "y"}', '{"mint": "m4"}', "junk"]
    got = flow.launches(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert {(r.mint, r.kind) for r in got} == {("m1", "create"), ("m2", "migrate"), ("m3", "create")}


def test_stream_of_bars_is_the_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir).trades.where("price_usd is not null").withColumn("ts", F.timestamp_seconds("sec"))
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flow.live_bars(stream, "1 day", "40 days").writeStream.format("memory").queryName("bars_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    a = {(r.pair_address, r.t, round(r.close, 6), r.n_trades) for r in spark.table("bars_test").select("pair_address", F.unix_timestamp("window.start").alias("t"), "close", "n_trades").collect()}
    b = {(r.pair_address, r.bucket, round(r.close, 6), r.n_trades) for r in market.ohlcv(t.withColumn("block_number", F.lit(0)), 86400).collect()}
    assert a == b and a


def test_ingest_resumes_without_duplicates(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "k long, v string").write.mode("append").parquet(source)
        flow.ingest(spark.readStream.schema("k long, v string").parquet(source), target, mark, ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_reports_and_frames(spark, tmp_path):
    rows = spark.createDataFrame([("bsc", "p", 1, 2.0), ("bsc", "q", 1, 3.0)], "chain string, pair_address string, ts long, close double")
    for kind in ("csv", "json", "parquet"):
        lake.write_report(rows, f"{tmp_path}/{kind}", kind)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        assert reader.format(kind).load(f"{tmp_path}/{kind}").count() == 2
    lake.write_frames(rows, str(tmp_path), "1h")
    lake.write_frames(rows.where("pair_address = 'q'").withColumn("close", F.lit(9.0)), str(tmp_path), "1h")
    assert sorted((r.pair_address, r.close) for r in spark.read.parquet(f"{tmp_path}/frames").collect()) == [("p", 2.0), ("q", 9.0)]


def test_bounded_collection(spark, tmp_path):
    spark.createDataFrame([(i, "migrate" if i % 5 == 0 else "create") for i in range(30)], "k int, kind string").coalesce(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert flow.collect_bounded(stream, f"{tmp_path}/out", f"{tmp_path}/check", most=7, seconds=60, skip=F.col("kind") == "migrate") == 7
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 7 and got.where("kind = 'migrate'").count() == 0
    assert flow.collect_bounded(stream, f"{tmp_path}/out2", f"{tmp_path}/check2", most=1000, seconds=8) == 30
