"""Command line: init, query, import, stats, verify, nodes, edges, history, dump, demo, repl."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Db, EdgeInput
from .errors import GraphError, NotFoundError, StorageError
from .operators.traverse import revision_chain
from .sources import render
from .sources.importers import format_of, import_edges
from .sources.store import Files


# ------------------------------------------------------------------------------------------------------------
# The demonstration graph. Kinds of nodes; then edges as source, target, type, start, source, confidence, in the
# order they are written: first ones, the one that supersedes carol's report, the end of alice's work, later ones. Edges are
# observed when they start.
DEMO_NODES = {"person": ("alice", "bob", "carol", "dan", "eve", "frank"), "org": ("acme", "beta_labs"), "project": ("pluto", "quasar")}
DEMO_FIRST = (
    ("alice", "acme", "WORKS_AT", "2026-01-15T09:00:00Z", "hr", 1.0),
    ("bob", "acme", "WORKS_AT", "2026-01-15T09:00:00Z", "hr", 1.0),
    ("carol", "acme", "WORKS_AT", "2026-01-15T09:00:00Z", "hr", 1.0),
    ("dan", "acme", "WORKS_AT", "2026-01-15T09:00:00Z", "hr", 1.0),
    ("bob", "alice", "REPORTS_TO", "2026-01-20T09:00:00Z", "hr", 1.0),
    ("carol", "alice", "REPORTS_TO", "2026-01-20T09:00:00Z", "hr", 1.0),
    ("alice", "bob", "WORKS_WITH", "2026-01-25T14:00:00Z", "slack", 0.85),
    ("alice", "carol", "WORKS_WITH", "2026-01-25T14:00:00Z", "slack", 0.85),
    ("bob", "carol", "WORKS_WITH", "2026-01-25T14:00:00Z", "slack", 0.85),
    ("carol", "dan", "WORKS_WITH", "2026-01-25T14:00:00Z", "slack", 0.85),
    ("eve", "acme", "WORKS_AT", "2026-02-10T09:00:00Z", "hr", 1.0),
    ("eve", "alice", "REPORTS_TO", "2026-02-10T09:00:00Z", "hr", 1.0),
)
DEMO_SUPERSEDED = ("carol", "bob", "REPORTS_TO", "2026-03-01T09:00:00Z", "hr", 1.0)
DEMO_ENDED = "2026-03-15T17:00:00Z"
DEMO_LATER = (
    ("alice", "beta_labs", "WORKS_AT", "2026-03-16T09:00:00Z", "linkedin", 0.95),
    ("alice", "pluto", "WORKS_ON", "2026-04-01T10:00:00Z", "github", 0.99),
    ("bob", "pluto", "WORKS_ON", "2026-04-01T10:00:00Z", "github", 0.99),
    ("carol", "pluto", "WORKS_ON", "2026-04-01T10:00:00Z", "github", 0.99),
    ("frank", "acme", "WORKS_AT", "2026-04-05T10:00:00Z", "hr", 1.0),
    ("dan", "quasar", "WORKS_ON", "2026-04-05T10:00:00Z", "github", 0.99),
    ("frank", "quasar", "WORKS_ON", "2026-04-05T10:00:00Z", "github", 0.99),
)
# ------------------------------------------------------------------------------------------------------------


def demo(db: Db) -> None:
    """Ten people, organisations and projects over some months, with an invalidated and a superseded edge."""

    def given(edge: tuple) -> EdgeInput:
        source, target, kind, at, told_by, confidence = edge
        return EdgeInput(source, target, kind, at, None, at, told_by, confidence)

    with db.write() as w:
        for kind, names in DEMO_NODES.items():
            for name in names:
                w.upsert_node(name, kind)
        made = {edge[:3]: w.add_edge(given(edge)) for edge in DEMO_FIRST}
        w.supersede_edge(made["carol", "alice", "REPORTS_TO"], given(DEMO_SUPERSEDED))
        w.invalidate_edge(made["alice", "acme", "WORKS_AT"], DEMO_ENDED)
        for edge in DEMO_LATER:
            w.add_edge(given(edge))


def _stats(db: Db, as_json: bool) -> str:
    s = db.read().stats()
    if as_json:
        return json.dumps({"path": db.path, "nodes": s["node_count"], "edges": s["edge_count"], "events": s["event_count"], "strings": s["string_count"]}, separators=(",", ":")) + "\n"
    return f"Database: {db.path}\n  nodes:   {s['node_count']}\n  edges:   {s['edge_count']}\n  events:  {s['event_count']}\n  strings: {s['string_count']}\n"


def repl(db: Db, lines=sys.stdin, out=sys.stdout) -> None:
    """Queries line by line; an error does not end it."""
    for line in lines:
        line = line.strip()
        if line in (".quit", ".q", ".exit"):
            return
        if not line:
            continue
        try:
            if line == ".help":
                out.write(".help .stats .quit, or a query\n")
            else:
                out.write(_stats(db, False) if line == ".stats" else db.query_text(line))
        except GraphError as error:
            out.write(f"error: {error}\n")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "query", "import", "stats", "verify", "fsck", "nodes", "edges", "history", "dump", "demo", "repl"):
        sub = commands.add_parser(name)
        sub.add_argument("path")
        if name == "query":
            sub.add_argument("query")
        if name == "import":
            sub.add_argument("--file", required=True)
            sub.add_argument("--format", choices=["csv", "jsonl"])
        if name == "history":
            sub.add_argument("edge_id", type=int)
        if name in ("query", "stats", "nodes", "edges"):
            sub.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    try:
        if given.command == "init" and Files(spark, given.path).exists("_meta.json"):
            raise StorageError(f"{given.path} exists")
        db = Db(given.path, spark, create=given.command in ("init", "import", "demo"))
        if given.command == "query":
            sys.stdout.write(db.query_json(given.query) + "\n" if given.json else db.query_text(given.query))
        elif given.command == "import":
            done = import_edges(db.store, given.file, given.format)
            print(f"Imported {done.count} edges ({format_of(given.file, given.format)})")
            if bad := done.errors.count():
                print(f"{bad} error(s):", *(f"  row {r.number}: {r.error}" for r in done.errors.limit(10).collect()), sep="\n", file=sys.stderr)
        elif given.command == "stats":
            sys.stdout.write(_stats(db, given.json))
        elif given.command in ("verify", "fsck"):
            report = db.read().verify()
            print(f"verifying {given.path}...", *(f"  ok {x}" for x in report.lines), sep="\n")
            if report.errors:
                print(*(f"  fail {x}" for x in report.errors), f"{len(report.errors)} error(s) found", sep="\n", file=sys.stderr)
                return 1
            print("all checks passed.")
        elif given.command in ("nodes", "edges"):
            snapshot = db.read()
            rows = (snapshot.all_nodes() if given.command == "nodes" else snapshot.all_edges()).toLocalIterator()
            sys.stdout.write(getattr(render, f"{given.command}_{'json' if given.json else 'text'}")(rows))
        elif given.command == "history":
            rows = revision_chain(db.read().edges, given.edge_id).orderBy("position").collect()
            if not rows:
                raise NotFoundError(f"edge {given.edge_id} not found")
            sys.stdout.write(render.history_text(rows))
        elif given.command == "dump":
            snapshot = db.read()
            sys.stdout.write(render.dump_text(snapshot.events_between().toLocalIterator(), snapshot.version.counts["log"]))
        elif given.command == "demo":
            demo(db)
            sys.stdout.write(_stats(db, False))
        elif given.command == "repl":
            repl(db)
    except GraphError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
