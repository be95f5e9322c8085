import random

import pytest

from lattica.operators import groups as G


def least_reachable(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for e in edges for x in e}


@pytest.mark.parametrize("kind", ["sparse", "dense", "path", "star", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    some = lambda n, m: [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges = {"sparse": some(200, 150), "dense": some(100, 300), "path": [(i, i + 1) for i in range(150)], "star": [(99, i) for i in range(90)], "loops": [(7, 7), (9, 7), (5, 5)], "none": []}[kind]
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_reachable(edges)


def test_intermediates_are_released_by_name(spark):
    a, b = G.cut(spark.range(3), "a"), G.cut(spark.range(4), "b")
    mine = [p for p in G.written() if "lattica-a-" in p][-1:]
    assert G.release(spark, mine) == 1 and b.count() == 4 and mine[0] not in G.written()
    with pytest.raises(Exception):
        a.count()
