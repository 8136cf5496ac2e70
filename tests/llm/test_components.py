from __future__ import annotations

import random

import pytest

from tickloom.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(99, k) for k in range(20)], [(40 - k, 39 - k) for k in range(0, 40, 2)] + [(1, 38), (5, 5)]], ids=["none", "loop", "path", "star", "pairs"])
def test_shapes(spark, edges):
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == brute(edges)


def test_any_graph(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)]
    assert {r.node: r.label for r in components(spark.createDataFrame(edges * 2, "a long, b long")).collect()} == brute(edges)
