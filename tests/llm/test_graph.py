"""Connected components, in one task and in rounds."""

import random

import pytest

from ammlytics.llm._graph import components


@pytest.mark.parametrize("local", [1_000_000, 40, 0])
def test_components(spark, local):
    rng = random.Random(3)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, x) for x in range(1001, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5000, 5000), (7, 8), (8, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.label for r in components(table, local_edges=local).collect()} == want
    assert components(table.limit(0), local_edges=local).count() == 0
