"""Path measures of many sources at once against the search from each one."""

import random

import numpy as np
import pandas as pd
import pytest

from biblioscope import storage
from biblioscope.operators import graph


def edges(n, m, seed):
    draw = random.Random(seed)
    found = {(i, i + 1): draw.choice([1.0, 2.0, 3.0]) for i in range(n - 1) if i % 17}
    while len(found) < m:
        a, b = sorted(draw.sample(range(n), 2))
        found[a, b] = draw.choice([0.5, 1.0, 2.0, 4.0])
    return [(a, b, w) for (a, b), w in found.items()]


@pytest.mark.parametrize("at_a_time", [64, 1 << 22])
def test_paths_together(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(graph, "AT_A_TIME", at_a_time)
    df = spark.createDataFrame([*edges(60, 150, 3), (100, 101, 2.0)], "a long, b long, weight double")
    row = lambda r: (r.node, *(pytest.approx(x, abs=1e-9) for x in (r.betweenness, r.closeness, r.farthest, r.total_distance)))
    fast = sorted(graph.path_measures(df).collect())
    with monkeypatch.context() as own:
        own.setattr(graph, "_paths_together", lambda *a: None)
        slow = sorted(graph.path_measures(df).collect())
    assert [tuple(r) for r in fast] == [row(r) for r in slow] and len(fast) == 62


def test_long_paths_are_searched_one_by_one(monkeypatch):
    names, tail, head, cost = graph._arcs(pd.DataFrame(edges(60, 150, 4), columns=["a", "b", "weight"]))
    assert graph._paths_together(len(names), tail, head, cost, np.arange(10)) is not None
    monkeypatch.setattr(graph, "ROUNDS", 1)
    assert graph._paths_together(len(names), tail, head, cost, np.arange(10)) is None


@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_graphs_are_labelled_in_one_task(spark, kind):
    """By one stored table and no rounds of joins, with the labels that the rounds give."""
    cast = str if kind == "string" else int
    pairs = [*((a, b) for a, b, _ in edges(60, 60, 5)), *((i, i - 1) for i in range(300, 200, -1)), (400, 400), (500, None)]
    df = spark.createDataFrame([tuple(None if x is None else cast(x) for x in p) for p in pairs], f"a {kind}, b {kind}")
    before = len(storage._made)
    fast = sorted(graph.components(df).collect())
    assert len(storage._made) == before + 1
    assert fast == sorted(graph.components(df, small=0).collect()) and len(fast) > 150
    assert graph.components(df.limit(0)).count() == 0


def test_report_labels_once_and_finds_no_communities_unasked(spark, monkeypatch):
    df = spark.createDataFrame([*edges(60, 150, 3), (100, 101, 2.0)], "a long, b long, weight double")
    whole = graph.report(spark, "r", df).first().asDict()
    called = []
    labels = graph.components
    monkeypatch.setattr(graph, "components", lambda *a: called.append(a) or labels(*a))
    monkeypatch.setattr(graph, "communities", None)
    own = graph.report(spark, "r", df, grouped=False).first().asDict()
    assert len(called) == 1 and own == whole | {"modularity": None} and whole["modularity"] is not None
    far = [r for r in graph.path_measures(df).collect() if r.node < 100]
    assert own["mean_path"] == round(sum(r.total_distance for r in far) / (len(far) * (len(far) - 1)), 4) and own["diameter"] == round(max(r.farthest for r in far), 2)


def test_blocks_of_sources_go_to_tasks_of_their_own(spark, monkeypatch):
    """Few bytes are much work: blocks aren't put together by their bytes."""
    df = spark.createDataFrame(edges(60, 150, 3), "a long, b long, weight double")
    want = sorted(graph.path_measures(df).select("node", "total_distance").collect())
    monkeypatch.setattr(graph, "SOURCES", 3)
    found = graph._by_blocks(storage.stored(graph.with_components(df), "labelled"), False)
    assert found.rdd.getNumPartitions() >= 20
    assert sorted(found.select("node", "total_distance").collect()) == want


@pytest.mark.parametrize(("kind", "weights"), [("long", (1.0, 2.0, 3.0)), ("string", (5.0, 6.0, 7.0, 11.0)), ("long", (0.5, 2.0))])
def test_edges_are_sent_once(spark, monkeypatch, kind, weights):
    """No copy of a component's edges is shuffled for each block of its sources; distances in units give what the blocks give."""
    cast = (lambda x: f"n{x:03}") if kind == "string" else int
    draw = random.Random(9)
    own = [(cast(a), cast(b), draw.choice(weights)) for a, b, _ in [*edges(60, 150, 3), (100, 101, 0), (0, 1, 0), *((200, x, 0) for x in range(201, 520))]]
    df = spark.createDataFrame(own, f"a {kind}, b {kind}, weight double")
    monkeypatch.setattr(graph, "SOURCES", 50)
    monkeypatch.setattr(graph, "TURN", 7)
    row = lambda r: (r.node, *(pytest.approx(x, abs=1e-9) for x in (r.betweenness, r.closeness, r.farthest, r.total_distance)))
    with monkeypatch.context() as old:
        old.setattr(graph, "SENT_EDGES", 0)
        want = sorted(graph.path_measures(df).collect())
    with monkeypatch.context() as new:
        new.setattr(graph, "_arcs", None)
        out = graph.path_measures(df)
        assert [tuple(r) for r in sorted(out.collect())] == [row(r) for r in want] and len(want) == 382
    monkeypatch.setattr(graph, "_in_units", lambda n, c, s, f=graph._in_units: f(n, c, s) if len(s) == 1 else None)
    assert [tuple(r) for r in sorted(graph.path_measures(df).collect())] == [row(r) for r in want]


def test_units():
    assert graph._units(np.array([2.0, 3.0, 2.0])) == ({2.0: 3, 3.0: 2}, 6)
    assert graph._units(np.array([0.0, 1.0])) is None and graph._units(np.array([np.pi])) is None and graph._units(np.arange(1.0, 40.0)) is None
    path = [(i, i + 1) for i in range(99)]
    a, b = np.array(path).T
    found = [graph._in_units(100, graph._classes(100, a, b, np.full(99, c)), np.arange(3)) for c in (1, 30, 900)]
    assert found[2] is None or found[2].max() == 99 * 900
    assert graph._in_units(100, graph._classes(100, a, b, np.full(99, 2)), np.array([50])).max() == 100
