import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm import queries as Q
from weftline.llm.sharding import extendible_shards, sharded_documents, write_shards


def bits(d, text):
    a = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16)
    b = int(hashlib.md5((text or "").encode()).hexdigest()[:7], 16)
    return f"{a:032b}{b:028b}"


def plain(rows, limit):
    """Split one bucket at a time, as a directory grows."""
    held = {"": [(d, len((t or "").encode()), bits(d, t)) for d, t in rows]}
    while over := [p for p, r in held.items() if sum(x[1] for x in r) > limit and len(p) < 60]:
        for p in over:
            for r in held.pop(p):
                held.setdefault(r[2][: len(p) + 1], []).append(r)
    return sorted(((d, n, f"b{p}", len(p), sum(x[1] for x in r)) for p, r in held.items() for d, n, _ in r), key=repr)


@pytest.mark.parametrize("limit", [50, 700, 10_000, 1 << 40])
def test_shards_as_a_growing_directory(spark, limit):
    rows = [(i, "x" * (i % 90)) for i in range(300)] + [(7, f"text {i} of one id") for i in range(40)] + [(None, f"no id {i}" * 3) for i in range(40)] + [(1, None), (2, "")]
    rows = [r for r in rows if len(r[1] or "") <= limit]
    out = extendible_shards(with_clash(documents(spark, rows), "shard", "h", "prefix", "depth"), limit)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows, limit)


def test_overflow_pages(spark):
    rows = [(1, "same text")] * 50 + [(2, "long " * 100), (3, "y")] + ODD
    out = extendible_shards(documents(spark, rows), 40).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    size, count = defaultdict(int), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(n <= 40 or count[s] == 1 for s, n in size.items())
    assert len({r.shard for r in out if r.doc_id == 1 and r.n_bytes}) == 13
    docs = sharded_documents(documents(spark, rows).repartition(5), 40).collect()
    size, count = defaultdict(int), Counter()
    for r in docs:
        size[r.shard] += len((r.text or "").encode())
        count[r.shard] += 1
    assert len(docs) == len(rows) and all(n <= 40 or count[s] == 1 for s, n in size.items())
    assert len({r.shard for r in docs if r.text == "same text"}) == 13


def test_documents_and_files(spark, tmp_path):
    docs = with_clash(documents(spark, [(i, "z" * 50) for i in range(100)] + ODD[:5]), "h", "shard", "prefix")
    out = sharded_documents(docs, 300)
    want = Counter((r.doc_id, r.shard) for r in extendible_shards(docs, 300).collect())
    assert Counter((r.doc_id, r.shard_2) for r in out.collect()) == want
    assert out.columns == [*docs.columns, "shard_2", "depth"] and {r.shard for r in out.collect()} == {r.shard for r in docs.collect()}
    write_shards(docs, str(tmp_path / "shards"), 300)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard_2").distinct().count() == len({s for _, s in want})
    assert extendible_shards(documents(spark, [])).count() == 0 and sharded_documents(documents(spark, [])).count() == 0


def test_copies_spread_over_shards(spark, tmp_path):
    docs = documents(spark, [(i, "z" * 40) for i in range(50)]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    docs.union(docs).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(2, "at").sortWithinPartitions("at").drop("at").write.parquet(str(tmp_path / "mix"))
    twice = spark.read.parquet(str(tmp_path / "mix"))
    out = sharded_documents(twice, 200, spread_copies=True).collect()
    apart = Counter(len({r.shard for r in out if r.doc_id == i}) for i in range(50))
    assert len(out) == 100 and apart[2] >= 40
    size = Counter()
    for r in out:
        size[r.shard] += len(r.text)
    assert max(size.values()) <= 200


def test_sql_on_a_smaller_limit(spark):
    path = "/root/testdata/sf0.01"
    got = extendible_shards(spark.read.parquet(f"{path}/documents.parquet"), 1 << 16)
    sql = Q.oracle_sql()["op10_sharding"].replace(str(64 << 20), str(1 << 16))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM ({sql})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.agg(F.max("shard_bytes")).first()[0] <= 1 << 16
