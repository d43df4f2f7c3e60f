from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.graph.helpers import edges
from weftline.errors import QueryError
from weftline.functions.predicates import conjunction, term
from weftline.functions.timeutil import MAX_NS, MIN_NS, format_ns, format_ns_column, parse_ns, parse_ns_column
from weftline.operators.temporal import live

GOOD = {
    "1970-01-01": 0, " 2026-03-01 ": 1_772_323_200 * 10**9, "2026-03-01T10:00:00Z": 1_772_359_200 * 10**9, "2026-03-01T10:00:00.5+02:00": 1_772_352_000 * 10**9 + 5 * 10**8, "1969-12-31T23:59:59.999999999Z": -1,
    "2026-03-01t10:00:00z": 1_772_359_200 * 10**9, "9999-12-31": MAX_NS, "0001-01-01": MIN_NS, "2026-03-01T10:00:00.1234567891Z": 1_772_359_200 * 10**9 + 123_456_789,
}
BAD = ["2026/03/01", "2026-3-1", "2026", "now", "", "2026-03-01 10:00:00", "2026-03-01T10:00:00", "2026-02-30", "2026-03-01T24:00:00Z", "2026-03-01T10:61:00Z"]


def test_parsing_is_strict():
    for text, ns in GOOD.items():
        assert parse_ns(text) == ns, text
    for text in BAD:
        with pytest.raises(QueryError):
            parse_ns(text)


def test_columns_agree(spark):
    frame = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string")
    got = {r.t: r.ns for r in frame.select("t", parse_ns_column(F.col("t")).alias("ns")).collect()}
    assert got == {**GOOD, **dict.fromkeys(BAD)}
    stamps = [0, -1, 1, 1_772_359_200 * 10**9 + 120_000_000, -(10**18), 10**18 + 7]
    rows = spark.createDataFrame([(n,) for n in stamps], "ns long").select("ns", format_ns_column(F.col("ns")).alias("t")).collect()
    assert all(r.t == format_ns(r.ns) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(MIN_NS, MAX_NS))
def test_round_trip(ns):
    assert parse_ns(format_ns(ns)) == ns
    if abs(ns) < 9 * 10**18:
        assert datetime.fromtimestamp(ns // 10**9, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") == format_ns(ns)[:19]


def test_liveness(spark):
    rows = edges(spark, [(1, "a", "b", 100, 200), (2, "a", "b", 100, None), (3, "a", "b", 150, 150)])
    alive = lambda t: [r.edge_id for r in rows.where(live(t)).orderBy("edge_id").collect()]
    assert [alive(t) for t in (50, 100, 150, 199, 200, 99_999_999)] == [[], [1, 2], [1, 2], [1, 2], [2], [2]]


def test_terms(spark):
    rows = edges(spark, [(1, "a", "b", 0, None, "T", "slack", 0.9), (2, "a", "b", 10**9, 2 * 10**9, "U", "", 0.7)])
    pick = lambda *t: [r.edge_id for r in rows.where(conjunction(t)).orderBy("edge_id").collect()]
    assert pick(("confidence", ">=", 0.9)) == [1] and pick(("confidence", "=", 0.7)) == [2] and pick(("confidence", "<", 1)) == [1, 2]
    assert pick(("type", "!=", "T")) == [2] and pick(("edge_type", "<=", "T")) == [1] and pick(("source", "=", "")) == [2]
    assert pick(("valid_to", ">", "2200-01-01")) == [1] and pick(("valid_to", "=", "2500-01-01")) == [1]
    assert pick(("valid_from", ">", "1970-01-01"), ("observed_at", "=", "1970-01-01T00:00:01Z")) == [2]
    for bad in (("TYPE", "=", "x"), ("props", "=", "x"), ("type", "=", 1), ("confidence", "=", "x"), ("valid_to", "=", 5), ("valid_to", "=", "soon")):
        with pytest.raises(QueryError):
            term(*bad)


def test_whole_liveness_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    edges(spark, [(1, "a", "b", 0, None)]).write.parquet(str(tmp_path / "e"))
    plan = spark.read.parquet(str(tmp_path / "e")).where((F.col("from_ext_id") == "a") & live(5))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(valid_from_ns,5)" in plan and "Or(IsNull(valid_to_ns),GreaterThan(valid_to_ns,5))" in plan
