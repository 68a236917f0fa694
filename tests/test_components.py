from __future__ import annotations

import random

from loanline.operators.components import connected_components


def brute(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def test_random_graphs(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3), (4, None), (1, 2), (2, 1)]
    got = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000, 1001 + i) for i in range(500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == brute(chain)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0
