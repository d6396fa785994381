"""Connected components, with and without hubs, against union and find; where intermediate results may lie."""

import random
from types import SimpleNamespace

import pytest

from kerbside import storage
from kerbside.operators import graph


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_equal_union_find(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, k) for k in range(300, 360)] + [(k, k + 1) for k in range(500, 540)]
    edges += [edges[0], (7, 7), (360, 77)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "graph").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "graph").count() == 0


def test_a_cluster_needs_a_shared_folder():
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.shared_folder(away)
