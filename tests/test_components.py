import random

import pytest

from leadspark.components import connected_components


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5), (None, 3)]
    edges += [(2000, 2000 + i) for i in range(1, 60)] + [(3000 - i, 3001 - i) for i in range(40)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted((n, top(n)) for n in root)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
