import random

import pytest

from askframe.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def cases():
    draw = random.Random(5)
    yield []
    yield [(1, 1), (None, 2), (3, None)]
    yield [(i, i + 1) for i in range(40)]  # a long path
    yield [(0, i) for i in range(1, 200)] + [(200 + i, 1000 - i) for i in range(30)]  # a hub
    yield [(draw.randrange(150), draw.randrange(150)) for _ in range(110)] * 2


@pytest.mark.parametrize("edges", cases())
def test_equal_to_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rows = components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == plain(edges)


def test_text_nodes(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string")
    assert {(r.node, r.root) for r in components(df).collect()} == {
        ("a", "a"), ("b", "a"), ("c", "a"), ("z", "y"), ("y", "y")}
