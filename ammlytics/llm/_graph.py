"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammlytics.llm._spark import written

#: Edges that one task joins up at most.
LOCAL_EDGES = 100_000


def _forest(local_edges: int):
    """A task's edges as stars: each node with the smallest one that the task's own edges reach. The task may have far more than ``local_edges`` edges
    (few large files are few tasks): it lets go of what it holds whenever that has more nodes than so many edges can have."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars():
            nodes = [x for x in up if up[x] != x]
            for at in range(0, len(nodes), 50_000):
                part = nodes[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([root(x) for x in part], np.int64)), pa.array(np.array(part, np.int64))], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
                if len(up) > 2 * local_edges:
                    yield from stars()
                    up.clear()
        yield from stars()

    return run


def components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node of edges(a, b), longs: label is the smallest node reachable.

    Tasks of at most ``local_edges`` edges first join up what they hold. If there is more than one such task, rounds of large-star and
    small-star follow, each a shuffle of the remaining edges: a node's neighbours are linked to the smallest of them, an edge in, an edge
    out, so the table never grows and rounds grow as the logarithm of the longest path. Duplicate edges and loops are allowed; an empty
    table gives an empty result.
    """
    arcs = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tasks = max(1, -(-arcs.count() // max(1, local_edges)))  # local_edges 0: rounds only
    arcs = arcs.coalesce(tasks).mapInArrow(_forest(local_edges), "a long, b long") if local_edges else arcs
    arcs = written(arcs)
    before = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy(F.col("a").alias("u")).agg(F.least("u", F.min("b")).alias("m")))
        # Both sides of each join are plain tables, so that AQE can split the rows of a hub.
        large = written(arcs.join(low, arcs.a == low.u).select(F.col("m").alias("a"), "b").distinct())
        down = written(large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m")))
        small = large.join(down, large.b == down.v).select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        arcs = written(small.where("a <> b").distinct())
        now = arcs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    nodes = arcs.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.unionByName(arcs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
