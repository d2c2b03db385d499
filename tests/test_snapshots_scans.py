"""Versions of a table under crashes and rivals; interval sets; resumed scans."""

import random

import pytest
from pyspark.sql import functions as F

from ammlytics.sources import scans
from ammlytics.sources.snapshots import Conflict, Snapshots


def rows(spark, values):
    return spark.createDataFrame(values, "pair string, x int")


def seen(df):
    return sorted((r["pair"] or "-", r["x"]) for r in df.collect())


def test_versions_are_whole_and_readers_are_pinned(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["pair"], buckets=8)
    assert table.latest() == 0 and table.read() is None
    assert table.upsert(rows(spark, [("a", 1), ("a", 2), ("b", 3), (None, 9)])) == 1
    before = table.read()
    assert table.upsert(rows(spark, [("a", 7), ("c", 8)])) == 2
    assert seen(before) == [("-", 9), ("a", 1), ("a", 2), ("b", 3)]  # read after the second upsert
    assert seen(table.read()) == [("-", 9), ("a", 7), ("b", 3), ("c", 8)] and seen(table.read(1)) == seen(before)
    assert table.upsert(rows(spark, [(None, 1)])) == 3 and seen(table.read())[0] == ("-", 1)


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["pair"], buckets=4)
    table.upsert(rows(spark, [("a", 1), ("b", 2)]))
    table.prepare(rows(spark, [("a", 99)]), 1)  # killed here
    other = Snapshots(spark, str(tmp_path / "t"), ["pair"], buckets=4)
    assert other.latest() == 1 and seen(other.read()) == [("a", 1), ("b", 2)]
    assert other.upsert(rows(spark, [("b", 3)])) == 2 and seen(other.read()) == [("a", 1), ("b", 3)]
    assert other.expire(1) >= 1 and other.versions() == [2] and seen(other.read()) == [("a", 1), ("b", 3)]


def test_of_two_rivals_one_starts_anew(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["pair"], buckets=4)
    one, two = table.prepare(rows(spark, [("a", 1)]), 0), table.prepare(rows(spark, [("b", 2)]), 0)
    table.commit(one)
    with pytest.raises(Conflict):
        table.commit(two)
    assert table.upsert(rows(spark, [("b", 2)])) == 2 and seen(table.read()) == [("a", 1), ("b", 2)]
    assert not [n for n in table._listed("_versions") if not n.endswith(".json")]


def test_upserts_take_new_columns_and_empty_input(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["pair"], buckets=4)
    table.upsert(rows(spark, [("a", 1), ("b", 2)]))
    table.upsert(rows(spark, [("b", 5)]).withColumn("y", F.lit("new")))
    assert sorted((r["pair"], r["x"], r["y"]) for r in table.read().collect()) == [("a", 1, None), ("b", 5, "new")]
    table.upsert(rows(spark, []))
    assert table.latest() == 3 and table.read().count() == 2


def blocks(ranges):
    return {(k, b) for k, first, last in ranges for b in range(first, last + 1)}


def test_interval_sets_are_sets(spark):
    rng = random.Random(5)
    for _ in range(3):
        wanted, done = ([(rng.choice("ab"), a := rng.randrange(60), a + rng.randrange(-2, 12)) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        w, d = (spark.createDataFrame(x, "k string, first long, last long") for x in (wanted, done))
        for got, want in ((scans.merged(w, ["k"]), blocks(wanted)), (scans.subtracted(w, d, ["k"]), blocks(wanted) - blocks(done))):
            found = sorted((r["k"], r["first"], r["last"]) for r in got.collect())
            assert blocks(found) == want
            assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(found, found[1:], strict=False))
        cut = [(r["k"], r["first"], r["last"]) for r in scans.chunked(w, 5).collect()]
        assert blocks(cut) == blocks(wanted) and all(0 <= z - a < 5 for _, a, z in cut)


def test_chunks_have_no_budget_unless_given(spark):
    w = spark.createDataFrame([("a", 0, 99_999)], "k string, first long, last long")
    assert scans.chunked(w, 5).count() == 20_000 and scans.chunked(w, 5).where("truncated").count() == 0
    assert scans.chunked(w, 5, budget=7).where("truncated").count() == 7


def test_backfill_resumes_after_failures_and_crashes(spark, tmp_path):
    tape = spark.range(1000).select(F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("pair"), F.col("id").alias("block_number"))
    wanted = spark.createDataFrame([("p0", 0, 999), ("p1", 100, 5000)], "pair string, first long, last long")
    fill = scans.Backfill(spark, str(tmp_path / "f"), ["pair"], "pair string, block_number long")

    def fetch(bad):
        def run(chunks):
            failed = chunks.where(bad)
            good = chunks.where(f"not ({bad})").withColumnRenamed("pair", "_p")
            return tape.join(good, (F.col("pair") == F.col("_p")) & F.col("block_number").between(F.col("first"), F.col("last"))).select(*tape.columns), failed

        return run

    first = fill.run(wanted, fetch("first % 300 = 0"), head=900, size=100, flush_blocks=250)
    assert first["note"] == "scanned" and first["failed"] == 7 and first["chunks"] == 10 + 9
    left = {(r["pair"], r["first"], r["last"]) for r in scans.remaining(wanted, fill.ledger(), ["pair"], 900).collect()}
    assert left == {("p0", 0, 99), ("p0", 300, 399), ("p0", 600, 699), ("p0", 900, 900), ("p1", 300, 399), ("p1", 600, 699), ("p1", 900, 900)}

    def dies(chunks):
        rows, _ = fetch("false")(chunks)
        rows.withColumn("run", F.lit("dead")).write.partitionBy("run").mode("append").parquet(str(tmp_path / "f" / "rows"))
        raise RuntimeError("killed after its rows were written")

    with pytest.raises(RuntimeError):
        fill.run(wanted, dies, head=900, size=100)
    second = fill.run(wanted, fetch("false"), head=900, size=100)
    assert second["failed"] == 0 and second["chunks"] == len(left)
    assert fill.run(wanted, fetch("false"), head=900, size=100)["note"] == "already up to date"
    got = fill.rows()
    assert got.count() == got.distinct().count() == tape.where("block_number <= 900 and (pair = 'p0' or block_number >= 100)").count()
    assert fill.run(wanted, fetch("false"), head=905, size=100)["rows"] == 5  # the head moved on
