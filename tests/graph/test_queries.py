import duckdb
import pytest

from weftline import queries as Q

PATH = "/root/testdata/sf0.001"
TABLES = "supplier orders lineitem events nation".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return found


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_as_duckdb(spark, con, name):
    got = Q.queries()[name](spark, PATH)
    columns = sorted(got.columns)
    found = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, row, strict=True)) for row in found.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[c] for c in columns) for r in want), key=repr)


def test_point_queries_prune(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = Q.queries()["neighbors_as_of"](spark, PATH)._jdf.queryExecution().toString()
    assert "EqualTo(from_ext_id,customer:" in plan and "LessThanOrEqual(valid_from_ns," in plan and "Python" not in plan
