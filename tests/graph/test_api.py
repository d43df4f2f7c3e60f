import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.api import Db, EdgeInput, NodeInput, Snapshot
from weftline.cli import demo, main, repl
from weftline.errors import FormatError, InternalError, NotFoundError, QueryError, SchemaError, StorageError
from weftline.functions.timeutil import parse_ns
from weftline.operators import temporal
from weftline.schema import EDGES


def ids(result):
    return [e.id for e in result]


@pytest.fixture(scope="module")
def thesis(spark, tmp_path_factory):
    db = Db(str(tmp_path_factory.mktemp("g") / "thesis"), spark)
    # fixed values: the scenario that the golden answers below belong to
    with db.write() as w:
        for a, kind, b, start, end, source, confidence in [
            ("alice", "WORKS_AT", "Acme", "2026-01-01", None, "hr", 1.0),
            ("bob", "VENDOR", "Acme", "2026-02-15", None, "erp", 1.0),
            ("charlie", "CONSULTS", "Acme", "2026-03-05", "2026-04-01", "email", 0.8),
            ("server_9", "DEPENDS_ON", "vendor_2", "2026-01-01", None, "config", 1.0),
            ("incident_7", "CAUSED_BY", "server_9", "2026-03-05", None, "pagerduty", 0.95),
            ("company_123", "RELATES", "dep_1", "2026-01-01", None, "x", 1.0),
            ("dep_1", "RELATES", "dep_2", "2026-01-15", None, "x", 1.0),
        ]:
            w.add_edge(a, b, kind, valid_from=start, valid_to=end, observed_at=start, source=source, confidence=confidence)
    return db


def test_thesis_queries(thesis):
    q = lambda text: None if (r := thesis.query(text)) is None else ids(r)
    assert q('FIND NEIGHBORS OF "alice"') == [1]
    assert q('FIND 2 HOPS FROM "company_123" AT "2026-02-01"') == [6, 7]
    assert q('SHOW PATH FROM "incident_7" TO "vendor_2" BEFORE "2026-03-10"') == [5, 4]
    assert q('SHOW PATH FROM "incident_7" TO "vendor_2" BEFORE "2026-03-04"') is None
    assert q('SHOW PATH FROM "alice" TO "alice"') == []
    assert [q(f'WHO WAS CONNECTED TO "Acme" ON "2026-{d}"') for d in ("03-01", "03-05", "04-01")] == [[1, 2], [1, 2, 3], [1, 2]]
    found = json.loads(thesis.query_json('DIFF GRAPH BETWEEN "2000-01-01" AND "2099-01-01" FOR NODE "server_9"'))
    assert found["summary"] == {"nodes_added": 10, "nodes_removed": 0, "edges_added": 7, "edges_invalidated": 0, "edges_superseded": 0, "properties_updated": 0} and len(found["entries"]) == 17
    strict = thesis.read().compiler(strict_for_node=True).run('DIFF GRAPH BETWEEN "2000-01-01" AND "2099-01-01" FOR NODE "server_9"')
    assert strict.summary.first().edges_added == 2 and strict.summary.first().nodes_added == 1
    with pytest.raises(NotFoundError):
        q('FIND NEIGHBORS OF "ghost" AT "soon"')
    with pytest.raises(QueryError):
        q('FIND NEIGHBORS OF "alice" AT "soon"')
    with pytest.raises(ValueError):
        q('WHAT CHANGED BETWEEN "2000-01-01" AND "2001-01-01"')


def test_executor_sample(spark, tmp_path):
    db = Db(str(tmp_path / "g"), spark)
    with db.write() as w:
        w.add_edge("alice", "bob", "WORKS_WITH", valid_from="2026-01-15", source="slack", confidence=0.9)
        w.add_edge("carol", "alice", "REPORTS_TO", valid_from="2026-02-01", source="hr")
        w.add_edge("dan", "alice", "ADVISES", valid_from="2026-01-01", valid_to="2026-03-15", source="email", confidence=0.7)
    who = 'WHO WAS CONNECTED TO "alice" ON "2026-02-15"'
    q = lambda text: ids(db.query(text))
    assert q(who) == [1, 3, 2] and q('WHO WAS CONNECTED TO "alice" ON "2026-04-01"') == [1, 2]
    assert q(who + ' WHERE type = "WORKS_WITH"') == [1] and q(who + " WHERE confidence >= 0.9") == [1, 2] and q(who + " LIMIT 1") == [1] and len(q(who + " WHERE confidence >= 0.8 LIMIT 10")) == 2
    assert q('SHOW PATH FROM "carol" TO "bob" AT "2026-03-01"') == [2, 1] and q('FIND 2 HOPS FROM "carol" AT "2026-03-01"') == [2, 1]
    assert q('SHOW PATH FROM "carol" TO "bob" AT "2026-03-01" WHERE type = "none"') == [] and db.query_text('SHOW PATH FROM "carol" TO "bob" AT "2026-03-01" WHERE type = "none"') == "(source == target)\n"


@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    db = Db(str(tmp_path_factory.mktemp("g") / "demo"), spark)
    demo(db)
    return db


def test_demo(shown):
    q = lambda text: None if (r := shown.query(text)) is None else ids(r)
    assert shown.read().stats() == {"node_count": 10, "edge_count": 20, "event_count": 33, "string_count": 11}
    assert q('FIND NEIGHBORS OF "alice"') == [7, 8, 14, 15] and q('FIND NEIGHBORS OF "alice" AT "2026-02-15"') == [1, 7, 8]
    assert q('WHO WAS CONNECTED TO "carol" ON "2026-02-15"') == [3, 6, 10, 8, 9] and q('WHO WAS CONNECTED TO "carol" ON "2026-03-15"') == [3, 10, 13, 8, 9]
    assert q('FIND NEIGHBORS OF "alice" WHERE confidence >= 0.9 LIMIT 10') == [14, 15] and q('FIND 2 HOPS FROM "acme"') == []
    assert q('FIND 2 HOPS FROM "alice"') == [7, 8, 14, 15, 2, 5, 9, 16, 3, 10, 13, 17]
    assert [q(f'SHOW PATH FROM "{a}" TO "{b}"') for a, b in (("alice", "dan"), ("eve", "quasar"), ("acme", "alice"))] == [[8, 10], [12, 8, 10, 19], None]
    s = shown.read()
    assert ids(s.revision_chain(13)) == [13, 6] and s.revision_chain(99) == []
    kinds = [(r.event_id, r.kind) for r in s.events_between().collect()]
    assert kinds == [*((i, 1) for i in range(1, 11)), *((i, 3) for i in range(11, 23)), (23, 4), (24, 3), (25, 5), (26, 4), (27, 3), *((i, 3) for i in range(28, 34))]
    assert s.verify().errors == [] and s.get_edge(1).valid_to == "2026-03-15T17:00:00Z" and s.get_edge(6).valid_to == "2026-03-01T09:00:00Z"
    assert s.node_id("bob") == 2 and s.node_id("x") is None and s.get_node(7).node_type == "org" and s.get_node_by_ext_id("eve").id == 5
    assert s.view_edge(13).supersedes == 6 and s.all_nodes().count() == 10 and s.all_edges().count() == 20
    assert ids(s.reverse_neighbors_as_of("acme", "2026-03-20")) == [2, 3, 4, 11] and ids(s.neighbors("alice")) == [7, 8, 14, 15]
    with pytest.raises(InternalError):
        s.view_edge(77)


def test_rendering(shown):
    text = shown.query_text('FIND NEIGHBORS OF "alice" AT "2026-02-15" LIMIT 1')
    assert text == "alice        -[WORKS_AT]-> acme          valid=[2026-01-15T09:00:00Z..2026-03-15T17:00:00Z)  obs=2026-01-15T09:00:00Z  src=hr  conf=1.00\n"
    assert shown.query_text('SHOW PATH FROM "alice" TO "dan"') == "alice -[WORKS_WITH]-> carol -[WORKS_WITH]-> dan\n"
    assert shown.query_text('SHOW PATH FROM "acme" TO "alice"') == "(no path)\n" and shown.query_text('FIND 2 HOPS FROM "acme"') == "(no edges)\n"
    found = json.loads(shown.query_json('FIND NEIGHBORS OF "alice" LIMIT 1'))
    assert found == {"kind": "edges", "count": 1, "edges": [{"id": 7, "from": "alice", "to": "bob", "type": "WORKS_WITH", "valid_from": "2026-01-25T14:00:00Z", "valid_to": None, "observed_at": "2026-01-25T14:00:00Z", "source": "slack", "confidence": 0.85, "supersedes": None}]}
    assert shown.query_json('SHOW PATH FROM "acme" TO "alice"') == '{"kind":"path","found":false,"edges":[]}'
    diff = shown.query_text('WHAT CHANGED BETWEEN "2000-01-01" AND "2099-01-01"')
    assert diff.startswith("summary: +10 nodes, -0 nodes, +20 edges, !2 invalidated, ~1 superseded\n+ node  @") and "! edge  e6  @" in diff and "(ev ev25)" in diff


def test_writes(spark, tmp_path):
    db = Db(str(tmp_path / "g"), spark)
    with db.write() as w:
        assert w.upsert_node("a", "person", {"n": None, "b": True, "i": 5, "f": 1.5, "s": "x", "raw": b"\0"}) == 1
        assert w.upsert_node(NodeInput("a", "robot")) == 1 and w.get_node_id("a") == 1 and w.get_node_id("b") is None
        e = w.add_edge("a", "b", "T", valid_from="2026-01-01", properties={"k": 1, "z": b"\1", "f": 2.0})
        for bad in ({"confidence": 1.5}, {"confidence": float("nan")}, {"valid_from": "2026-01-02", "valid_to": "2026-01-01"}, {"properties": {"x": []}}):
            with pytest.raises(SchemaError):
                w.add_edge("q", "r", "T", **bad)
        for args in (("", "b", "T"), ("a", "", "T"), ("a", "b", "")):
            with pytest.raises(SchemaError):
                w.add_edge(*args)
    s = db.read()
    assert s.get_node(1).node_type == "person" and s.stats()["node_count"] == 2 and s.verify().errors == []
    assert json.loads(db.query_json('FIND NEIGHBORS OF "a"'))["edges"][0]["properties"] == {"f": 2, "k": 1, "z": "<bytes>"}
    with db.write() as w:
        w.invalidate_edge(e, "2026-06-01")
        w.invalidate_edge(e, "2026-07-01")  # later: nothing happens
        w.add_edge("a", "a", "LOOP", valid_from="2026-01-01")
        new = w.supersede_edge(e, EdgeInput("a", "c", "T", "2026-05-01"))
        with pytest.raises(NotFoundError):
            w.invalidate_edge(99, "2026-01-01")
        with pytest.raises(NotFoundError):
            w.supersede_edge(99, EdgeInput("a", "b", "T"))
        with pytest.raises(SchemaError):
            w.invalidate_edge(e, "2025-01-01")
    later = db.read()
    assert later.get_edge(e).valid_to == "2026-05-01T00:00:00Z" and later.get_edge(new).supersedes == e
    assert s.get_edge(e).valid_to is None and s.stats()["event_count"] == 3  # an older snapshot stays as it was
    assert later.stats()["event_count"] == 9 and later.verify().errors == []
    assert db.read(1).get_edge(e).valid_to is None
    with pytest.raises(RuntimeError), db.write() as w:
        w.add_edge("x", "y", "T")
        raise RuntimeError
    with pytest.raises(ZeroDivisionError):
        db.write_with(lambda w: (w.upsert_node("gone"), 1 / 0))
    assert db.read_with(lambda r: r.node_id("gone")) is None and db.write_with(lambda w: w.upsert_node("a")) == 1
    assert db.read().stats() == later.stats() and Db(db.path, spark).read().stats() == later.stats()
    first, second = db.write(), db.write()
    first.upsert_node("n1"), second.upsert_node("n2")
    first.commit()
    with pytest.raises(StorageError):
        second.commit()
    with pytest.raises(InternalError):
        first.commit()
    db.store.compact()
    packed = db.read()
    assert packed.version.folders["edges_in"] and ids(packed.reverse_neighbors_as_of("c", "2026-05-02")) == [new]
    with db.write() as w:
        late = w.add_edge("z", "c", "T", valid_from="2026-05-01")
    assert ids(db.read().reverse_neighbors_as_of("c", "2026-05-02")) == [new, late] and ids(db.query('WHO WAS CONNECTED TO "c" ON "2026-05-02"')) == [new, late]
    assert packed.verify().errors == [] and packed.get_edge(e).valid_to == "2026-05-01T00:00:00Z"
    _, edges = packed.recorded_until(s.version.recorded_at_ns)
    assert [(r.edge_id, r.valid_to_ns) for r in edges.collect()] == [(e, None)]


def test_state_is_the_fold_of_the_log(spark, tmp_path):
    r, db = random.Random(7), Db(str(tmp_path / "g"), spark)
    held = []
    for _ in range(4):
        with db.write() as w:
            for _ in range(25):
                if held and r.random() < 0.4:
                    try:
                        w.invalidate_edge(r.choice(held), r.randrange(50, 100))
                    except SchemaError:
                        pass
                elif held and r.random() < 0.3:
                    try:
                        held.append(w.supersede_edge(r.choice(held), EdgeInput(r.choice("abc"), r.choice("abc"), "T", r.randrange(40, 90))))
                    except SchemaError:
                        pass
                else:
                    start = r.randrange(50)
                    held.append(w.add_edge(r.choice("abcd"), r.choice("abcd"), "T", valid_from=start, valid_to=r.choice([None, start + r.randrange(60)])))
    s = db.read()
    names = [n for n in EDGES.names if n != "props"]
    assert sorted(map(tuple, temporal.fold_edges(s.log).select(*names).collect()), key=repr) == sorted(map(tuple, s.edges.select(*names).collect()), key=repr)
    assert s.verify().errors == []


def test_verify_finds_faults(spark, shown):
    from pyspark.sql import functions as F

    from weftline.operators.verify import violations

    s = shown.read()
    bad = s.edges.withColumn("valid_to_ns", F.when(F.col("edge_id") == 2, F.lit(0)).otherwise(F.col("valid_to_ns"))).withColumn("confidence", F.when(F.col("edge_id") == 3, F.lit(2.0)).otherwise(F.col("confidence")).cast("float"))
    nodes = s.nodes.where("ext_id <> 'quasar'").union(s.nodes.where("ext_id = 'eve'"))
    found = {(r.check, r.id) for r in violations(nodes, bad.union(bad.where("edge_id = 5")), s.log).collect()}
    assert {("inverted", 2), ("confidence", 3), ("to_missing", 19), ("to_missing", 20), ("node_id_repeated", 5), ("ext_id_repeated", 5), ("edge_id_repeated", 5), ("fold", 2), ("fold", 3), ("fold", 5)} == found


def test_opening(spark, tmp_path):
    with pytest.raises(NotFoundError):
        Db(str(tmp_path / "none"), spark, create=False)
    (tmp_path / "junk").write_text("junk")
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "x").write_text("x")
    for name in ("junk", "folder"):
        with pytest.raises(FormatError):
            Db(str(tmp_path / name), spark)
    db = Db(str(tmp_path / "g"), spark)
    with pytest.raises(NotFoundError):
        db.read(5)
    assert Snapshot(db.store).stats()["node_count"] == 0 and db.query_json('WHAT CHANGED BETWEEN "2000-01-01" AND "2001-01-01"')


def test_command_line(spark, tmp_path, capsys, shown):
    path = str(tmp_path / "g")
    assert main(["init", path], spark) == 0
    (tmp_path / "e.csv").write_text("from,to,edge_type,valid_from\na,b,T,2026-01-01\nbad\n")
    assert main(["import", path, "--file", str(tmp_path / "e.csv")], spark) == 0
    out = capsys.readouterr()
    assert out.out == "Imported 1 edges (csv)\n" and "1 error(s):\n  row 3: expected at least 3 columns" in out.err
    assert main(["query", path, 'FIND NEIGHBORS OF "a"', "--json"], spark) == 0 and '"count":1' in capsys.readouterr().out
    assert main(["stats", shown.path, "--json"], spark) == 0 and '"nodes":10,"edges":20,"events":33' in capsys.readouterr().out
    for command, part in (("nodes", "n1     alice                type=person          created="), ("edges", "e1     alice        -[WORKS_AT]-> acme"), ("dump", "events: 33\n  [   ev1] @"), ("verify", "all checks passed."), ("stats", "  edges:   20")):
        assert main([command, shown.path], spark) == 0 and part in capsys.readouterr().out
    assert main(["history", shown.path, "13"], spark) == 0 and capsys.readouterr().out.startswith("→ [e13] carol      -[REPORTS_TO]-> bob")
    assert len(json.loads((main(["edges", shown.path, "--json"], spark), capsys.readouterr().out)[1])) == 20
    assert len(json.loads((main(["nodes", shown.path, "--json"], spark), capsys.readouterr().out)[1])) == 10
    assert main(["history", shown.path, "99"], spark) == 1 and main(["query", str(tmp_path / "none"), "x"], spark) == 1 and main(["query", path, "x"], spark) == 1
    import io

    out = io.StringIO()
    repl(shown, iter([".help", "nonsense", ".stats", 'FIND NEIGHBORS OF "frank"', ".quit", "never"]), out)
    assert "error: query error" in out.getvalue() and "nodes:   10" in out.getvalue() and "quasar" in out.getvalue() and "never" not in out.getvalue()


def test_instants():
    from weftline.api import instant

    assert instant("2026-01-01") == parse_ns("2026-01-01") and instant(5) == 5 and instant(None, lambda: 7) == 7


def test_viewing_an_edge_checks_its_ends(spark, tmp_path):
    db = Db(str(tmp_path / "g"), spark)
    with db.write() as w:
        w.add_edge("a", "b", "T", valid_from=0)
    s = db.read()
    assert s.view_edge(1).to_id == "b"
    with pytest.raises(InternalError):
        s.view_edge(9)
    s.nodes = s.nodes.where("ext_id <> 'b'")
    with pytest.raises(InternalError, match="dangling to"):
        s.view_edge(1)


def test_verify_looks_at_meta_keys_and_gaps(spark, tmp_path):
    db = Db(str(tmp_path / "g"), spark)
    with db.write() as w:
        for i in range(5):
            w.add_edge(f"n{i}", "m", "T", valid_from=i)
    s = db.read()
    assert s.verify().errors == [] and "meta: magic, version, features present" in s.verify().lines
    meta = tmp_path / "g" / "_meta.json"
    text = meta.read_text()
    held = json.loads(text)
    del held["writer_version"]
    meta.unlink()
    (tmp_path / "g" / "._meta.json.crc").unlink(missing_ok=True)
    meta.write_text(json.dumps(held))
    assert s.verify().errors == ["meta key missing: writer_version"] and "meta: see errors" in s.verify().lines
    s.log = s.log.where("event_id not in (2, 3, 4)")
    late = s.log.where("event_id = 1").withColumn("recorded_at_ns", F.col("recorded_at_ns") + 10**15)
    s.log = s.log.where("event_id > 1").unionByName(late)
    assert sum(e.startswith("event_order") for e in s.verify().errors) == s.log.count() - 1
    assert s.verify(most=2).errors[-1].startswith("and ")


def test_init_refuses_any_graph(spark, tmp_path, capsys):
    path = str(tmp_path / "g")
    assert main(["init", path], spark) == 0 and main(["init", path], spark) == 1
    assert "exists" in capsys.readouterr().err
