import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrata.llm import _graph
from kestrata.llm._graph import _forest, connected_components, least_reachable


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 30), st.integers(-6, 30)), max_size=40))
def test_forest_of_a_part(edges):
    a, b = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ((), ())))
    node, least = least_reachable(a, b)
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {x: r for x, r in plain(edges).items() if x != r}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40), st.integers(1, 7))
def test_forests_of_bounded_parts_connect_what_the_edges_connect(edges, part):
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([x for x, _ in edges[i : i + 3]], pa.int64()), pa.array([y for _, y in edges[i : i + 3]], pa.int64())], names=["a", "b"]) for i in range(0, len(edges), 3)]
    found = [(r["a"], r["b"]) for b in _forest(part)(iter(batches)) for r in b.to_pylist()]
    want = {x: r for x, r in plain([(x, y) for x, y in edges if x != y]).items()}
    assert plain(found) == want and all(x > y for x, y in found)


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_components_of_chains_hubs_and_cliques(spark, part):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(x, y) for x in range(1000, 1008) for y in range(1000, 1008)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(-5, 3_000_000_000), (7, 7)]
    rng.shuffle(edges)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), part).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got) and got == plain([(x, y) for x, y in edges if x != y])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_components_are_done_after_a_round(spark, monkeypatch):
    rnd = random.Random(9)
    nodes = rnd.sample(range(-(10**12), 10**12), 12_000)
    edges = [tuple(rnd.sample((g := nodes[i : i + 4]), 2)) for i in range(0, 12_000, 4) for _ in range(4)]
    edges += [(nodes[i], nodes[i + 1]) for i in range(0, 600)]  # and one long path through some of them
    rows = []
    whole = _graph.written
    monkeypatch.setattr(_graph, "written", lambda df: (rows.append((out := whole(df))[0].count()), out)[1])
    got = {r.node: r.component for r in _graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6), 2000).collect()}
    assert got == plain(edges)
    assert sum(rows) < 5 * rows[0], rows
