import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from weftline.llm.common import clear_scratch, connected_components, join_checked, materialize, pieces, scratch, spread_buckets


def plain_components(edges):
    at = {x: x for e in edges for x in e}
    for a, b in edges:
        old, new = max(at[a], at[b]), min(at[a], at[b])
        at = {k: new if v == old else v for k, v in at.items()}
    return at


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],  # a chain
    [(0, i) for i in range(1, 300)] + [(299, 500)],  # a hub
    [(5, 5), (7, 7), (7, 8), (8, 7), (-3, 8)],  # loops, both ways, negative
    [],
])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_random_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == plain_components([e for e in edges if e[0] != e[1]])


def test_buckets_meet_in_bounded_groups(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 3), (3, 20), (4, 95)) for i in range(n)]
    small, large = spread_buckets(spark.createDataFrame(rows, "key long, v long"), "key", 5, 30, F.xxhash64("v"))
    assert {(r.key, r.v) for r in small.collect()} == {(2, i) for i in range(3)}
    groups = {}
    for x in large.collect():
        groups.setdefault((x.key, x["__c"], x["__d"]), set()).add(x.v)
    for k, n in ((3, 20), (4, 95)):
        mine = [g for (key, *_), g in groups.items() if key == k]
        assert all(any({i, j} <= g for g in mine) for i in range(n) for j in range(i))
        assert max(map(len, mine)) < 90


def test_joins_either_way(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(50)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    for how in ("inner", "left"):
        broadcast, salted = (join_checked(left, right, ["k"], how, n, 7, F.col("v")) for n in (10, 1))
        assert sorted(map(tuple, broadcast.collect()), key=repr) == sorted(map(tuple, salted.collect()), key=repr)


def test_scratch_and_pieces(spark):
    from weftline.llm.common import _delete

    kept = materialize(spark.range(5))
    assert kept.count() == 5 and scratch(spark) in kept._weftline_path
    clear_scratch(spark)
    _delete(spark, scratch(spark))
    batch = documents(spark, [(i, "x" * n) for i, n in enumerate((3, 0, 50, 2, 2))] + [(9, None)]).toArrow().combine_chunks().to_batches()[0]
    assert [p.num_rows for p in pieces(batch, "text", 10)] == [2, 1, 3] and sum(p.num_rows for p in pieces(batch, "text", 1)) == 6
