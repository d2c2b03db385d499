"""Nearest neighbours by cosine: a forest of random-projection trees, searched through one priority queue, then exact reranking.

A tree splits the unit vectors of a bounded sample by the hyperplane between two of them, again and again, until a part stands
for a small share of the table. Every vector is put into one leaf of each tree. A query walks all trees at once: the queue holds
open branches of the whole forest, first the one whose hyperplanes the query is least far beyond (sum of squared distances along the
path), and leaves are opened until they stand for ``visit_share`` of the table. Leaves that are neighbours in a tree share a bucket; a
task holds one bucket, streams its queries and compares each with the leaves it opened, exactly (float64, original vectors); the best of
all buckets are merged. A bucket of too many vectors is dealt to several tasks, which all get its queries.

Equal vectors are one entry with its k + 1 smallest ids, so that thousands of copies are neither one leaf's rows nor one query's
candidates; every id is in the index.

Measured: the given vectors have no cluster structure (64 equal directions), so many leaves have to be opened for a recall of 0.9. With 4
trees of leaves of 1/2048 of the table (5 vectors at least) a share of 0.95 finds 0.92 of the 5 nearest of 500 vectors and 0.965 of those of 2,000,
and compares a query with about 0.62 of the different vectors; clustered vectors need a small share only.

Rows. A vector that is null or zero or has a null or non-finite component takes no part, as query or candidate; so does a null
vec_id, and a vector whose length isn't the most frequent one. Fewer than k candidates: all of them. Ties: the smaller vec_id.
Repeated rows (same vec_id and vector) count once. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm._spark import dealt, texts, written


def valid(table: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>").alias("vector")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v).where("vec_id is not null and size(vector) > 0")
    sound = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    return rows.where(sound)


def _classes(keep: int):
    """Distinct vectors of a task with their smallest ids."""

    def run(batches):
        schema = pa.schema([("key", pa.binary()), ("body", pa.binary()), ("ids", pa.list_(pa.int64()))])
        held: dict[bytes, list] = {}

        def out():
            rows = [(hashlib.blake2b(b, digest_size=16).digest(), b, ids) for b, ids in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(np.array(v, np.float64).tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > 4 * keep:
                        ids.sort()
                        del ids[keep:]
            if len(held) > 20_000:
                yield out()
                held = {}
        if held:
            yield out()

    return run


class Forest:
    """Random-projection trees over unit vectors: arrays of hyperplanes and children; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, trees: int, most: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, most, rng) for _ in range(trees)]
        self.plain = [(children.tolist(), sizes.tolist()) for _, _, _, children, sizes in self.trees]

    @staticmethod
    def _grow(sample, most, rng):
        normals, offsets, children, sizes = [], [], [], []

        def split(rows):
            if len(rows) <= most:
                sizes.append(max(1, len(rows)))
                return -len(sizes)
            for _ in range(8):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                side = sample[rows] @ normal
                cut = np.median(side)
                left = side < cut
                if left.any() and not left.all():
                    break
            else:  # equal vectors only
                sizes.append(len(rows))
                return -len(sizes)
            at = len(normals)
            normals.append(normal / (np.linalg.norm(normal) or 1)), offsets.append(cut / (np.linalg.norm(normal) or 1)), children.append(None)
            children[at] = (split(rows[left]), split(rows[~left]))
            return at

        root = split(np.arange(len(sample)))
        return root, np.array(normals).reshape(len(normals), sample.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(unit), len(self.trees)), np.int64)
        for t, (root, normals, offsets, children, _) in enumerate(self.trees):
            at = np.full(len(unit), root)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                side = (np.einsum("ij,ij->i", unit[live], normals[node]) >= offsets[node]).astype(int)
                at[live] = children[node, side]
                live = live[at[live] >= 0]
            out[:, t] = -at - 1
        return out

    def search(self, unit: np.ndarray, visit: int) -> list[tuple[int, int]]:
        """(tree, leaf) opened for one query until they stand for ``visit`` sample vectors."""
        queue = [(0.0, t, tree[0]) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        margins = [(normals @ unit - offsets).tolist() for _, normals, offsets, _, _ in self.trees]
        found, total = [], 0
        while queue and total < visit:
            far, t, node = heapq.heappop(queue)
            children, margin = self.plain[t][0], margins[t]
            while node >= 0:  # the near side is no farther, so it comes next; the other side waits
                m = margin[node]
                left, right = children[node]
                node, other = (right, left) if m >= 0 else (left, right)
                heapq.heappush(queue, (far + m * m, t, other))
            found.append((t, -node - 1))
            total += self.plain[t][1][-node - 1]
        return found


def _unit(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)
    scale = np.abs(v).max(1, keepdims=True)
    scaled = v / scale
    return v, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of each row of a with each row of b, float64, each pair by the same sum whatever stands around it.

    Rows are scaled by powers of two first, which changes no digit of the result, so that squares of very large or small components
    neither overflow nor vanish.
    """

    def scaled(x):
        return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])

    def norm(x):
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    a, b = scaled(a), scaled(b)
    return np.einsum("ik,jk->ij", a, b, optimize=False) / (norm(a)[:, None] * norm(b)[None, :])


def nearest(table: DataFrame, queries: str, *, k: int = 5, trees: int = 4, visit_share: float = 0.95, leaves: int = 2048, buckets: int = 32, bucket_most: int = 20_000, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """Of table(vec_id, embedding): query_id, rank, vec_id, score for the rows where the SQL condition ``queries`` on vec_id holds.

    sample: about how many distinct vectors (a fixed bound) the trees are grown on. visit_share: the opened leaves of a query, over all
    trees, stand for this share of the distinct vectors. leaves: leaves of a tree, fewer if they would hold under 5 vectors. buckets: groups
    of leaves of a tree; more tasks share one that would hold over bucket_most vectors.
    """
    spark = table.sparkSession
    texts(table, "vec_id")  # ships the package
    rows = valid(table)
    width = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    rows = rows.where(F.size("vector") == width[0].d)
    part = rows.mapInArrow(_classes(k + 1), "key binary, body binary, ids array<long>")
    entries = written(part.groupBy("key").agg(F.first("body").alias("body"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    asking = written(rows.where(queries).mapInArrow(_keys, "query_id long, key binary").distinct())
    total = entries.count()
    drawn = entries.where(F.expr("pmod(xxhash64(key), 1000000)") < 1_000_000.0 * sample / max(total, 1)).select("body").limit(2 * sample).toArrow()["body"].to_pylist()
    drawn = drawn or entries.select("body").limit(1).toArrow()["body"].to_pylist()
    _, unit = _unit(sorted(drawn))
    ratio = len(unit) / total
    leaf = max(5, total / leaves)
    visit = visit_share * total
    grown = Forest(unit, trees, max(2, round(leaf * ratio)), seed)
    per = max(1, max(len(sizes) for *_, sizes in grown.trees) // buckets)  # leaves of a bucket
    shares = max(1, round(total * per / max(1, min(len(sizes) for *_, sizes in grown.trees)) / bucket_most))
    forest = spark.sparkContext.broadcast(grown)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = forest.value.leaves(_unit(batch.column(1).to_pylist())[1])
                n, t = at.shape
                who = pa.array(np.repeat(np.arange(n), t))
                share = np.array([int.from_bytes(x[:4], "little") % shares for x in batch.column(0).to_pylist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(at.ravel() // per), pa.array(np.repeat(share, t)), pa.array(np.zeros(n * t, bool)), pa.array([x.tobytes() for x in at.ravel().astype(np.int32)], pa.binary()), batch.column(0).take(who), batch.column(1).take(who)], names=names)

    def walk(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 50):
                batch = whole.slice(start, 50)
                found = []
                for key, body, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unit(batch.column(1).to_pylist())[1], strict=True):
                    opened = np.array(forest.value.search(u, max(1, round(visit * ratio))), np.int64)
                    opened = opened[np.lexsort((opened[:, 1], opened[:, 0]))]
                    at = opened[:, 0] << 40 | opened[:, 1] // per
                    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
                    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        found += [(int(opened[a, 0]), int(opened[a, 1]) // per, i, True, opened[a:b, 1].astype(np.int32).tobytes(), key, body) for i in range(shares)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    names = ["tree", "bucket", "share", "asks", "leaf", "key", "body"]
    kinds = "tree int, bucket long, share int, asks boolean, leaf binary, key binary, body binary"
    seekers = entries.join(asking.select("key").distinct(), "key", "left_semi").select("key", "body")
    met = entries.select("key", "body").mapInArrow(place, kinds).unionByName(seekers.mapInArrow(walk, kinds))
    near = dealt(met, "tree", "bucket", "share").sortWithinPartitions("tree", "bucket", "share", "asks").mapInArrow(_compare(k + 1), "asker binary, key binary, score double")
    # the best k + 1 entries of each query, of equal ones those of the smallest vec_id, are enough: one may hold only the query itself
    scored = near.groupBy("asker", "key").agg(F.max("score").alias("score")).join(entries.select("key", F.col("ids")[0].alias("least")), "key")
    best = scored.groupBy("asker").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "least", "key"))), 1, k + 1).alias("best"))
    flat = best.select("asker", F.explode("best").alias("b")).select("asker", F.col("b.key").alias("key"), (-F.col("b.far")).alias("score"))
    flat = flat.join(entries.select("key", "ids"), "key").select("asker", "score", F.explode("ids").alias("vec_id"))
    ranked = flat.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    ranked = ranked.select("asker", F.slice("near", 1, k + 1).alias("near"))
    own = asking.join(ranked, asking.key == ranked.asker).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _keys(batches):
    for batch in batches:
        keys = [hashlib.blake2b(np.array(v, np.float64).tobytes(), digest_size=16).digest() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["query_id", "key"])


#: Scores of a bucket that a task holds at a time.
SCORES = 2_000_000


def _compare(keep: int):
    """Rows in order of bucket, candidates first: for each query of a bucket the best candidates of the leaves that it opened."""

    def run(batches):
        at, keys, bodies, leaf, state = None, [], [], [], None

        def answer(asking):
            nonlocal state
            if state is None:
                order = np.argsort(np.array(leaf), kind="stable")
                state = np.array(leaf)[order], [keys[i] for i in order], np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)[order]
            leaves, names, matrix = state
            a = np.frombuffer(b"".join([x[1] for x in asking]), np.float64).reshape(len(asking), -1)
            score = np.full((len(asking), len(names)), -np.inf)
            opened = [np.frombuffer(x[2], np.int32) for x in asking]
            owner, opened = np.repeat(np.arange(len(asking)), [len(x) for x in opened]), np.concatenate(opened)
            for one in np.unique(opened).tolist():
                lo, hi = np.searchsorted(leaves, [one, one + 1])
                if lo < hi:
                    who = owner[opened == one]
                    score[who, lo:hi] = cosine(a[who], matrix[lo:hi])
            rows = []
            for (asker, *_), s in zip(asking, score, strict=True):
                n = min(keep, len(s))
                least = max(np.partition(s, len(s) - n)[len(s) - n], -2.0)
                rows += [(asker, names[j], float(s[j])) for j in np.flatnonzero(s >= least).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["asker", "key", "score"])

        asking: list[tuple] = []
        for batch in batches:
            for *where, asks, leaves, key, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if where != at:
                    if asking:
                        yield answer(asking)
                    at, keys, bodies, leaf, state, asking = where, [], [], [], None, []
                if not asks:
                    keys.append(key), bodies.append(body), leaf.append(int.from_bytes(leaves, "little"))
                elif keys:
                    asking.append((key, body, leaves))
                    if len(asking) * len(keys) > SCORES:
                        yield answer(asking)
                        asking = []
        if asking:
            yield answer(asking)

    return run
