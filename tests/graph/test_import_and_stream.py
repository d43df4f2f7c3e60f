import json

import pytest
from pyspark.sql import functions as F

from weftline.api import Db
from weftline.functions.timeutil import parse_ns
from weftline.schema import EDGE_INPUT
from weftline.sources.bulk import bulk_add_edges
from weftline.sources.fixtures import ring
from weftline.sources.importers import format_of, import_edges
from weftline.sources.render import prop_value
from weftline.streaming.log import ingest, read_log, windowed_diff

NOW = parse_ns("2026-06-01")


def held(db):
    return [(r.edge_id, r.from_ext_id, r.to_ext_id, r.edge_type, r.valid_from_ns, r.valid_to_ns, r.observed_at_ns, r.source, round(r.confidence, 4)) for r in db.read().all_edges().collect()]


def test_csv(spark, tmp_path):
    lines = ["from,to,edge_type,valid_from", "a,b,T,2026-01-01", ' "a" , "c" ,T, 2026-01-01T00:00:00Z ,2026-02-01,2026-03-01," src ",0.5,more', "", "a,b", '"a,b",c,T', "a,b,T,2026-01-01,,,s,1.5", "a,b,T,soon", "x,y,T", "a,b,T,,,,s,abc", ",b,T", "b,a,T,2026-01-01,2025-01-01"]
    (tmp_path / "e.csv").write_text("\r\n".join(lines))
    db = Db(str(tmp_path / "g"), spark)
    done = import_edges(db.store, str(tmp_path / "e.csv"), now=NOW)
    day = parse_ns("2026-01-01")
    assert held(db) == [
        (1, "a", "b", "T", day, None, day, "", 1.0),
        (2, "a", "c", "T", day, parse_ns("2026-02-01"), parse_ns("2026-03-01"), " src ", 0.5),
        (3, "x", "y", "T", NOW, None, NOW, "", 1.0),
    ]
    assert [r.number for r in done.errors.collect()] == [5, 6, 7, 8, 10, 11, 12] and done.count == 3
    s = db.read()
    assert s.stats()["node_count"] == 5 and s.verify().errors == [] and s.stats()["event_count"] == 8
    assert [(r.kind, r.node.ext_id if r.node else r.edge.edge_id) for r in s.events_between().collect()] == [(1, "a"), (1, "b"), (3, 1), (1, "c"), (3, 2), (1, "x"), (1, "y"), (3, 3)]


def test_csv_without_header_and_parity(spark, tmp_path):
    (tmp_path / "e.txt").write_text("From,to,T\nq,r,T,2026-01-01,,,s,1.5\na,b,T\n")
    db = Db(str(tmp_path / "g"), spark)
    import_edges(db.store, str(tmp_path / "e.txt"), now=NOW, parity=True)
    assert [r[:4] for r in held(db)] == [(1, "From", "to", "T"), (3, "a", "b", "T")] and db.read().stats()["node_count"] == 6


def test_jsonl(spark, tmp_path):
    base = {"from": "a", "to": "b", "edge_type": "T", "valid_from": "2026-01-01"}
    good = [base | {"confidence": "0.5", "source": 7}, base | {"valid_from": 5, "confidence": 0.25}, base | {"properties": {"x": 1, "y": 1.5, "z": {"k": 1}, "n": None, "b": True, "s": "é"}, "extra": {"deep": 1}}]
    bad = [base | {"properties": {"l": [1]}}, {"from": "a", "to": "b"}, base | {"valid_to": "soon"}, base | {"to": 5}]
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, good), "", "not json", "[1]", *map(json.dumps, bad)]))
    db = Db(str(tmp_path / "g"), spark)
    done = import_edges(db.store, str(tmp_path / "e.jsonl"), now=NOW)
    assert [(r[4], r[7], r[8]) for r in held(db)] == [(parse_ns("2026-01-01"), "", 1.0), (NOW, "", 0.25), (parse_ns("2026-01-01"), "", 1.0)]
    assert [r.number for r in done.errors.collect()] == [5, 6, 7, 8, 9, 10]
    props = {k: prop_value(v) for k, v in db.read().edges.where("edge_id = 3").first().props.items()}
    assert props == {"x": 1, "y": 1.5, "n": None, "b": True, "s": "é"}


def test_formats():
    assert [format_of(p) for p in ("a.jsonl", "a.NDJSON", "a.json", "a.csv", "a")] == ["jsonl"] * 3 + ["csv"] * 2 and format_of("a.json", "csv") == "csv"


@pytest.mark.parametrize("parts", [1, 5])
def test_bulk_ids_in_input_order(spark, tmp_path, parts):
    db = Db(str(tmp_path / "g"), spark)
    rows = ring(spark, 40, 3).coalesce(1).repartition(parts, "from") if parts > 1 else ring(spark, 40, 3).coalesce(1)
    bulk_add_edges(db.store, rows)
    with db.write() as w:
        w.add_edge("n0", "new", "T")
    bulk_add_edges(db.store, ring(spark, 45))
    s = db.read()
    assert s.verify().errors == [] and s.version.counts["nodes"] == 46 and s.version.counts["edges"] == 120 + 1 + 45
    assert sorted(r.edge_id for r in s.edges.collect()) == list(range(1, 167)) and sorted(r.node_id for r in s.nodes.collect()) == list(range(1, 47))
    if parts == 1:
        first = s.edges.where("edge_id <= 3").orderBy("edge_id").collect()
        assert [(r.from_ext_id, r.to_ext_id) for r in first] == [("n0", "n1"), ("n0", "n2"), ("n0", "n3")] and [r.ext_id for r in s.nodes.orderBy("node_id").limit(4).collect()] == ["n0", "n1", "n2", "n3"]


def test_streams(spark, tmp_path):
    db = Db(str(tmp_path / "g"), spark)
    ring(spark, 10).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(EDGE_INPUT).parquet(str(tmp_path / "in"))
    ingest(db.store, stream(), str(tmp_path / "mark")).awaitTermination()
    assert db.read().version.counts["edges"] == 10
    ring(spark, 12).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(db.store, stream(), str(tmp_path / "mark")).awaitTermination()
    s = db.read()
    assert s.version.counts["edges"] == 22 and s.version.counts["nodes"] == 12 and s.verify().errors == []
    query = windowed_diff(read_log(spark, db.path)).writeStream.outputMode("update").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.table("counts").agg(F.sum("edges_added").alias("e"), F.sum("nodes_added").alias("n")).first()
    assert total.e >= 22 and total.n >= 12


def test_split_files_are_numbered_by_file(spark, tmp_path):
    """Lines keep their numbers and their order when a file is cut into many splits."""
    lines = ["from,to,edge_type,valid_from"] + [f"n{i},m,T,{'soon' if i % 100 == 7 else '2026-01-01'}" + ("\r" if i % 3 else "") for i in range(4000)]
    lines.insert(1500, "")
    (tmp_path / "e.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "e.csv")).rdd.getNumPartitions() > 8
        db = Db(str(tmp_path / "g"), spark)
        done = import_edges(db.store, str(tmp_path / "e.csv"), now=NOW)
        bad = [r.number for r in done.errors.collect()]
        names = [r.from_ext_id for r in db.read().all_edges().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    good = [i for i, x in enumerate(lines) if i and x and "soon" not in x]
    assert bad == [i + 1 for i, x in enumerate(lines) if "soon" in x]
    assert names == [lines[i].split(",")[0] for i in good] and done.count == len(good)
    assert not (tmp_path / "g" / "data" / ".scratch").exists() or not list((tmp_path / "g" / "data" / ".scratch").iterdir())
