"""Components of links that lie side by side: contracted where they lie, rounds only for what is cut."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.operators import topology

SF = "/root/testdata/sf0.001"


def pieces(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("links", [1 << 18, 5])
def test_components_of_runs(spark, monkeypatch, links):
    """Whole and cut ones: chains either way, a hub, loops, repeated links and null ends."""
    monkeypatch.setattr(topology, "LINKS", links)
    edges = [(k, k + 1) for k in range(50)] + [(200 - k, 199 - k) for k in range(60)] + [(5000, 1000 + k) for k in range(90)] + [(7, 7), (900, 900), (-3, 900), (8, 6), (6, 8), (8, 6)]
    df = spark.createDataFrame([*edges, (1, None), (None, 77), (None, None)], "a long, b long").repartition(4)
    found = [tuple(r) for r in topology.near_components(df).collect()]
    assert sorted(found) == sorted(pieces(edges).items())
    assert topology.near_components(df.where("false")).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["compose_decompose", "unbroken_pieces"])
def test_whole_solids_take_no_rounds(spark, monkeypatch, name):
    written = []
    whole = topology.materialize
    monkeypatch.setattr(topology, "materialize", lambda df, label: (written.append(label), whole(df, label))[1])
    assert entry.queries()[name](spark, SF).count() == 400
    assert written == ["stars"]
