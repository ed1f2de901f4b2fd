import random

import plain
import pytest

from tallyweave.llm import components as m


@pytest.mark.parametrize("per_task", [1_000_000, 150])
def test_against_plain(spark, monkeypatch, per_task):
    monkeypatch.setattr(m, "EDGES_PER_TASK", per_task)
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 120)] + [(500, k) for k in range(400, 500)] + [(9, 9), (700, 700)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    rng.shuffle(edges)
    groups = plain.Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = m.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(linked)
    assert {r["node"]: r["component"] for r in got} == {x: groups.find(x) for x in linked}


def test_empty(spark):
    assert m.components(spark.createDataFrame([], "a long, b long")).count() == 0
