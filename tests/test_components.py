import random

from concord.operators.components import connected_components


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5), (None, 3), (700, 701), (701, 700)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
