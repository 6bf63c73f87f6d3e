import random

import pytest

from washline.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(130)],  # a path: roots must double their reach
    [(0, i) for i in range(1, 400)] + [(500, 501), (502, 502)],  # a star, a pair, a loop
    [(random.Random(3).randrange(300), random.Random(i).randrange(300)) for i in range(150)],
    [(9, 4), (4, 9), (9, 4), (7, 4)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.root for r in components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
