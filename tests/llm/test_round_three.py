"""Vector codes, collocations and sharding against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ammlytics.llm import collocations, queries, sharding, vector_codes

DOCS = "doc_id long, text string, lang string, source string, row long, shard int, slot long, n long, words string, _hash string"


def table(spark, rows):
    """documents with further columns whose names the operators use inside. rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", 7, 7, 7, 7, "x", "y") for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_collocations", "op13_sharding"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries_equal_sql(spark, name, size):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '/root/testdata/{size}/{t}.parquet'")
    got = queries.QUERIES[name](spark, f"/root/testdata/{size}").toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    shown = [sorted(map(repr, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).values.tolist())) for df in (got, want)]
    assert sorted(got.columns) == sorted(want.columns) and shown[0] == shown[1]


# 13 --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 5])
def test_permutation_is_one_and_can_be_computed_both_ways(spark, n, seed):
    got = {r["row"]: r["position"] for r in sharding.permuted(spark.range(n).withColumnRenamed("id", "row"), "row", n, seed).collect()}
    assert sorted(got.values()) == list(range(n))
    for row in range(0, n, max(1, n // 100)):
        shard, slot = sharding.place(row, n, 16, seed)
        assert slot * 16 + shard == got[row] and sharding.row_at(shard, slot, n, 16, seed) == row


def test_permutation_shuffles(spark):
    n = 20_000
    p = np.array([r["position"] for r in sharding.permuted(spark.range(n).withColumnRenamed("id", "row"), "row", n).orderBy("row").collect()])
    assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.03 and abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.03
    assert np.bincount((p[1:] - p[:-1]) % 16).min() > n / 16 * 0.85
    assert np.bincount(p[:1600] % 16, minlength=16).max() < 150


def test_sharding_of_odd_rows(spark):
    rows = [(None, "a", "en"), (None, "b", None), (None, None, None), (5, "x" * 400_000, "en"), (5, "é日", "en"), (7, None, "en"), (7, "", "en"), *[(9, "same", "en")] * 300]
    got = sharding.shard_documents(table(spark, rows), 16).toPandas()
    assert sorted(got.row) == list(range(len(rows)))
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    ids = got.sort_values("row").doc_id
    assert ids.isna().sum() == 3 and ids[:3].isna().all() and ids[3:].is_monotonic_increasing
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    counts = got.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    for r in got.itertuples():
        assert sharding.place(r.row, len(rows), 16) == (r.shard, r.slot)


def test_sharding_does_not_depend_on_layout(spark):
    rows = [(i % 40, f"t{i % 60}", "en") for i in range(500)]
    one = sharding.shard_documents(table(spark, rows).coalesce(1)).toPandas()
    random.Random(1).shuffle(rows)
    other = sharding.shard_documents(table(spark, rows).repartition(7)).toPandas()
    assert sorted(map(tuple, one.values.tolist())) == sorted(map(tuple, other.values.tolist()))


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(table(spark, [])).count() == 0
    assert sharding.shuffled(table(spark, [])).count() == 0


def test_written_shards_hold_whole_rows_in_slot_order(spark, tmp_path):
    rows = [(i, f"text {i}", "en") for i in range(200)]
    sharding.write_shards(table(spark, rows), str(tmp_path / "shards"), shards=4, seed=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == set(DOCS.replace("_hash string", "").replace(",", "").split()[::2]) | {"row", "shard", "slot"}
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((i, t) for i, t, _ in rows)
    files = {}
    for r in back.select("shard", "slot", F.input_file_name().alias("file")).collect():
        files.setdefault((r["shard"], r["file"]), []).append(r["slot"])
    assert all(max(s) - min(s) + 1 == len(s) for s in files.values())
    assert {(r["shard"], r["slot"]) for r in back.where("doc_id = 77").collect()} == {sharding.place(77, 200, 4, 3)}


# 11 --------------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label string, vector string, code string, sums int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], VECTORS)


def lloyd(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python: every distance, whole numbers."""
    kept = [(i, [int(np.floor(4096 * x)) if abs(x) < 1e300 else int(x) * 4096 for x in v], label, v) for i, v, label in rows]
    width = len(kept[0][1])
    cut = [i * width // parts for i in range(parts + 1)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in zip(cut, cut[1:], strict=False)]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), j) for j, e in enumerate(books[p]))

    def assigned():
        return [[nearest(p, r[1][cut[p] : cut[p + 1]]) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [r[1][cut[p] : cut[p + 1]] for r, a in zip(kept, at, strict=True) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assigned()
    sha = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    total = collections.Counter()
    for r, a in zip(kept, at, strict=True):
        total[r[2]] += sum(d for d, _ in a)
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), total[r[2]], sha) for r, a in zip(kept, at, strict=True)), key=repr)


def compressed(spark, rows):
    found = vector_codes.compress(vectors(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 3 / 4096, 900.0, 3e4])
def test_codes_are_lloyd(spark, scale):
    """Small scales make ties; large ones leave two bytes, and 64 bits."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(6)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.2)) for c in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(1200, 0, -3)]
    rows += rows[:30]
    assert compressed(spark, rows) == lloyd(rows)


def test_codes_of_odd_rows(spark):
    good = [(5, [1.0] * 8, "a"), (None, [2.0] * 8, None), (5, [1.0] * 8, "a"), (3, [-1e-9, 0.0, 1e-3, 5.0, 4.0, 3.0, 2.0, 1.0], None)]
    bad = [(1, None, "a"), (2, [1.0, None] * 4, "a"), (4, [float("nan")] * 8, "a"), (6, [float("inf")] * 8, "b"), (7, [], "a"), (8, [1.0] * 16, "a")]
    assert compressed(spark, good + bad) == lloyd(good)
    assert compressed(spark, []) == [] and compressed(spark, bad[:5]) == []


def test_codes_of_copies_and_of_short_vectors(spark):
    rows = [(i, [0.25] * 12, "a") for i in range(40)]
    assert compressed(spark, rows) == lloyd(rows)
    rows = [(i, [i / 7.0, -i / 3.0, 0.1], f"l{i % 2}") for i in range(50)]
    assert compressed(spark, rows) == lloyd(rows)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (16, 8))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-400, 400, (3000, 8))).astype(np.int64)
    books = vector_codes.Codebooks([[list(map(int, v)) for v in centres]], [0, 8], 2, "int32")
    at, upper, lower = np.zeros(3000, int), np.full((3000,), vector_codes.NONE), np.zeros((3000, 16), int)
    at, upper, lower, first = vector_codes.reassigned(x, at, upper, lower, vector_codes.movements(books, None)[0], 2)
    moved = books._replace(entries=[[[v + 3 for v in e] for e in books.entries[0]]])
    at, upper, lower, then = vector_codes.reassigned(x, at, upper, lower, vector_codes.movements(moved, books)[0], 2)
    apart = ((x[:, None, :] - np.array(moved.entries[0])[None]) ** 2).sum(2)
    assert (at == apart.argmin(1)).all()
    assert (lower * 2 <= np.sqrt(apart) + 1e-9).all() and (upper * 2 >= np.sqrt(apart.min(1)) - 1e-9).all()
    assert then < first / 10 and first <= 3000 * 17


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], "a") for i in range(200)]
    books, working = vector_codes.train(vector_codes.valid(vectors(spark, rows)))
    for r in vector_codes.compress(vectors(spark, rows)).collect():
        whole = [int(np.floor(4096 * x)) for x in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(whole, vector_codes.decode(r["code"], books), strict=True)) == r["error"]


# 12 --------------------------------------------------------------------------------------------------------------------------


def counted(rows):
    count, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    return count, n


def ranked(rows, least, most):
    count, n = counted(rows)
    some = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    held = {(lang, w[i : i + k]) for (lang, w), a in some.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= count[(lang, w[i : i + k])]}
    out = []
    for (lang, w), a in some.items():
        if (lang, w) not in held:
            score, k = min((1000 * a * n[lang] // (count[(lang, w[:k])] * count[(lang, w[k:])]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), a, count[(lang, w[:k])], count[(lang, w[k:])], n[lang], score))
    found = []
    for lang in sorted(n):
        mine = sorted(x for x in out if x[0] == lang)[:most]
        found += [(lang, i + 1, x[3].decode(), *x[4:]) for i, x in enumerate(mine)]
    return found


def prose(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "B", "ç", "dd", "E.", "f,g", "\t", "\n", "zz\x01", "日本", "of", "the", "The", "of the"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80))), rng.choice(["en", "d e", "und", None, ""])) for i in range(n)]
    return rows + [(None, None, None), (1, "", "en"), (2, " . , ", "xx"), (3, "the of " * 20_000, "en"), *[(4, "one same text of some words", "en")] * 50]


def test_collocations_are_brute_force(spark):
    rows = prose(1)
    for least, most in ((5, 2000), (12, 7)):
        got = collocations.top_collocations(table(spark, rows), least, most).collect()
        assert sorted(map(tuple, got)) == sorted(ranked(rows, least, most))


def test_collocations_of_nothing(spark):
    assert collocations.top_collocations(table(spark, []), 1).count() == 0
    assert collocations.top_collocations(table(spark, [(1, None, None), (2, ".", "en")]), 1).count() == 0


def test_tries_merge_over_ranges_and_shards(monkeypatch):
    """Small shards, pieces and ranges: parts of nodes on edges add up, all others are whole."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 3000)
    monkeypatch.setattr(collocations, "PIECE", 400)
    monkeypatch.setattr(collocations, "GATHER", 900)
    rows = [r for r in prose(2, 60) if len(r[1] or "") < 2000]
    count, _ = counted(rows)
    bits = np.full(collocations.BITS // 64, -1, np.int64).view(np.uint64)

    class Bits:
        value = bits

    class Cuts:
        value = sorted([["en the", "en of", "en the"], ["en the", "en the"], ["d e dd"], [" b", " a", " c"], ["en same"], ["zz"]])

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["lang", "text"])
    merges = collections.defaultdict(collocations.Merge)
    for piece in collocations._tries(Bits, Cuts)(iter([batch])):
        merges[piece.column(0)[0].as_py()].add(piece.column(1)[0].as_py())
    assert len(merges) > 3
    parts = collections.defaultdict(list)
    for merge in merges.values():
        for lang, w, f, lefts in collocations.phrases(merge.paths(), 1):
            parts[(lang, tuple(w))].append((f, lefts))
    assert {p: sum(f for f, _ in x) for p, x in parts.items()} == dict(count)
    assert any(len(x) > 1 for x in parts.values())
    for (lang, w), x in parts.items():
        if len(x) > 1:
            assert all(v is None for _, lefts in x for v in lefts)
        for _, lefts in x:
            assert all(v is None or v == count[(lang, w[: k + 1])] for k, v in enumerate(lefts)) and len(lefts) == len(w)


def test_trie_round_trip_and_marks():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 5, (500, 5))
    for d in range(5):
        rows[rng.random(500) < 0.1, d:] = 0
    rows = rows[rows[:, 0] > 0]
    paths = collocations.Paths(["a", "b\nc", "ç", "zz"], rows, np.ones(len(rows), np.int64))
    names, back, counts = collocations.restored_paths(collocations.serialised(paths, 10, 60))
    want = [[paths.words[i - 1] if i else None for i in r] for r in paths.rows[10:60].tolist()]
    assert [[names[i - 1] if i else None for i in r] for r in back.tolist()] == want and counts.tolist() == paths.counts[10:60].tolist()
    bits = np.zeros(collocations.BITS // 64, np.uint64)
    assert not collocations.marked(np.arange(5, dtype=np.uint64), bits).any()
