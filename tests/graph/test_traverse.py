import random

import pytest

from tests.graph.helpers import edges, plain_search
from weftline.operators import temporal, traverse


def graph(seed, nodes=7, count=26):
    r = random.Random(seed)
    return [(i + 1, r.choice("abcdefg"[:nodes]), r.choice("abcdefg"[:nodes]), r.randrange(4), r.choice([None, None, 3, 6])) for i in range(count)]


@pytest.mark.parametrize("seed", range(6))
def test_order_ties_and_paths_as_a_queue(spark, seed):
    rows = [r for r in graph(seed) if r[4] is None or r[4] >= r[3]]
    frame = edges(spark, rows).cache()
    for hops in (0, 1, 2, 3, 5, 7):
        want, _ = plain_search(rows, "a", hops, 4)
        got = temporal.in_order(traverse.n_hops(frame, "a", hops, 4), "depth", "path").collect()
        assert [r.edge_id for r in got] == want, hops
    stepwise = temporal.in_order(traverse.n_hops(frame, "a", 3, 4, unrolled=0), "depth", "path").collect()
    assert [r.edge_id for r in stepwise] == plain_search(rows, "a", 3, 4)[0]
    _, paths = plain_search(rows, "a", 99, 4)
    for target in "abcdefg":
        found = traverse.shortest_path(frame, "a", target, 4)
        assert (None if found is None else [r.edge_id for r in found.orderBy("step").collect()]) == paths.get(target)
        lazy = [r.edge_id for r in traverse.bounded_path(frame, "a", target, 4).orderBy("step").collect()]
        assert lazy == (paths[target] if len(paths.get(target, [])) <= 4 and target in paths else [])
    limited = temporal.in_order(traverse.n_hops(frame, "a", 3, 4), "depth", "path", limit=5)
    assert [r.edge_id for r in limited.collect()] == plain_search(rows, "a", 3, 4)[0][:5]


def test_connected_has_loops_twice(spark):
    frame = edges(spark, [(1, "a", "a", 0, None), (2, "a", "b", 0, None), (3, "b", "a", 0, None)])
    got = temporal.in_order(temporal.connected(frame, "a", 1), "direction").collect()
    assert [r.edge_id for r in got] == [1, 2, 1, 3]


def test_chains(spark):
    frame = edges(spark, [(1, "a", "b", 0, None), (2, "a", "b", 1, None, "E", "s", 1.0, 1), (3, "a", "b", 2, None, "E", "s", 1.0, 2), (7, "a", "b", 2, None, "E", "s", 1.0, 8), (8, "a", "b", 2, None, "E", "s", 1.0, 7), (9, "a", "b", 2, None, "E", "s", 1.0, 99)])
    ids = lambda e: [r.edge_id for r in traverse.revision_chain(frame, e).orderBy("position").collect()]
    assert [ids(e) for e in (3, 1, 7, 9, 50)] == [[3, 2, 1], [1], [7, 8], [9], []]


def test_a_long_chain_and_a_long_path(spark):
    rows = [(i, f"n{i}", f"n{i + 1}", 0, None, "E", "s", 1.0, i - 1 if i > 1 else None) for i in range(1, 131)]
    frame = edges(spark, rows)
    assert traverse.revision_chain(frame, 130).count() == 130
    assert traverse.shortest_path(frame, "n1", "n9", 0).count() == 8


def test_chains_of_any_length(spark):
    rows = [(i, "a", "b", 0, None, "E", "s", 1.0, i - 1 if i > 1 else None) for i in range(1, 20_001)]
    frame = edges(spark, rows).cache()
    out = traverse.revision_chain(frame, 20_000).select("edge_id", "position").orderBy("position").collect()
    assert [(r.edge_id, r.position) for r in out] == [(20_000 - i, i) for i in range(20_000)]
    loop = edges(spark, [(*r[:8], 900 if r[0] == 1 else r[8]) for r in rows[:1000]])
    assert [r.edge_id for r in traverse.revision_chain(loop, 500).orderBy("position").collect()] == [*range(500, 0, -1), *range(900, 500, -1)]
    frame.unpersist()


def test_many_points(spark):
    rows = [(1, "a", "b", 0, 5), (2, "a", "b", 3, None), (3, "b", "c", 0, None)]
    points = spark.createDataFrame([("a", 1), ("a", 4), ("a", 9), ("b", 0), ("z", 1)], "ext_id string, at_ns long")
    got = sorted((r.ext_id, r.at_ns, r.edge_id) for r in temporal.as_of_many(edges(spark, rows), points).collect())
    assert got == [("a", 1, 1), ("a", 4, 1), ("a", 4, 2), ("a", 9, 2), ("b", 0, 3)]
