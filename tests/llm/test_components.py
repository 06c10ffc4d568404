import random

import pytest

from kinweave.llm import components as C
from kinweave.llm.common import Scratch


@pytest.mark.parametrize("together", [1_000_000, 25])
def test_chains_and_clouds(spark, monkeypatch, together):
    """Whether all edges fit into one task or the star steps are needed."""
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = random.Random(together)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    above = {x: x for e in edges for x in e}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    got = C.components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark, "t"), "r").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in above if find(x) != x} and len(got) == len({r.node for r in got})


def test_nothing(spark):
    assert C.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "r").count() == 0
