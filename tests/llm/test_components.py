"""Connected components against union-find, and that edges go as they are used."""

import random

from tidemark.llm import components as module


def brute(edges):
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {x: root(x) for x in up}


def test_rounds_read_only_the_edges_left(spark, monkeypatch):
    """A path, a hub and random edges: each round leaves fewer edges, so that all rounds together read a small multiple of them."""
    rng, plain, left = random.Random(8), module.cut, []

    def counted(df, name="cut"):
        out = plain(df, name)
        if name == "edges":
            left.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    for edges in ([(i, i + 1) for i in range(2000)], [(-1, i) for i in range(1500)] + [(3, 3)], [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1100)], []):
        left.clear()
        got = {r["node"]: r["component"] for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute(edges)
        assert left[-1] == 0 and sum(left) <= 2 * left[0], left
