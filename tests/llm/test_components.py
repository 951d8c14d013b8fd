import random

from weftline.llm.components import connected_components

from . import brute


def test_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2060)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    nodes = {n for e in real for n in e}
    assert got == brute.roots(nodes, real)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
