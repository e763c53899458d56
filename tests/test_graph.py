"""Connected components against union-find."""

from __future__ import annotations

import random

from revora.operators.graph import components


def _plain(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {x: top(x) for x in parent}


def test_random_and_long_paths(spark):
    rng = random.Random(2)
    for edges in ([(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)], [(i, i + 1) for i in range(100)], [(0, i) for i in range(1, 200)] + [(7, 7), (None, 3), (3, None)], []):
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
        assert got == _plain(edges)
