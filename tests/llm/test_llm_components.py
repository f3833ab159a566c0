"""Connected components whose ids make the contraction slow, against union-find."""

import random

from listloom.llm.common import connected_components


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def test_rising_chain_and_random_graph(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1, 400)]
    star = [(900, k) for k in range(800, 840)]
    other = [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(170)]
    edges = chain + star + [(a, b) for a, b in other if a != b]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == union_find(edges) and len(got) == len(union_find(edges))
