"""The Python surface: Db, Snapshot, WriteTxn, and the rows they return.

    db = Db("/data/graph", spark)
    with db.write() as w:
        w.add_edge("alice", "acme", "WORKS_AT", valid_from="2026-01-01")
    with db.read() as s:
        s.neighbors_as_of("alice", "2026-02-01")
    db.query('FIND 2 HOPS FROM "alice"')
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InternalError, NotFoundError, SchemaError
from .functions.timeutil import MAX_NS, MIN_NS, format_ns, now_ns, parse_ns
from .operators import diff, temporal, traverse, verify
from .plans.compiler import Compiler, Result
from .schema import EDGES, EVENTS, NODES
from .sources import render
from .sources.store import CUTS, META_KEYS, Store, Version

#: A transaction keeps all names in memory if the graph has at most so many nodes; otherwise it looks each one up.
FEW_NODES = 100_000
ROWS_A_FILE = 250_000


def instant(value: int | str | None, clock: Callable[[], int] = now_ns) -> int:
    return clock() if value is None else parse_ns(value) if isinstance(value, str) else int(value)


@dataclass(frozen=True)
class Edge:
    id: int
    from_id: str
    to_id: str
    edge_type: str
    valid_from: str
    valid_to: str | None
    observed_at: str
    source: str
    confidence: float
    supersedes: int | None

    @classmethod
    def of(cls, row) -> Edge:
        end = None if row.valid_to_ns is None else format_ns(row.valid_to_ns)
        return cls(row.edge_id, row.from_ext_id, row.to_ext_id, row.edge_type, format_ns(row.valid_from_ns), end, format_ns(row.observed_at_ns), row.source, row.confidence, row.supersedes)


@dataclass(frozen=True)
class Node:
    id: int
    ext_id: str
    node_type: str | None
    created_at: str

    @classmethod
    def of(cls, row) -> Node:
        return cls(row.node_id, row.ext_id, row.node_type, format_ns(row.created_at_ns))


@dataclass(frozen=True)
class NodeInput:
    ext_id: str
    node_type: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeInput:
    """valid_from and observed_at default to now, the end to open, the source to none, confidence to 1."""

    from_: str
    to: str
    edge_type: str
    valid_from: int | str | None = None
    valid_to: int | str | None = None
    observed_at: int | str | None = None
    source: str = ""
    confidence: float = 1.0
    properties: dict = field(default_factory=dict)


def stored_prop(value) -> tuple[str, str]:
    for kind, types, text in (("bool", bool, lambda v: str(v).lower()), ("int", int, str), ("float", float, repr), ("string", str, str), ("bytes", (bytes, bytearray), lambda v: base64.b64encode(v).decode())):
        if isinstance(value, types):
            if kind == "int" and not MIN_NS <= value <= MAX_NS:
                break
            return kind, text(value)
    if value is None:
        return "null", ""
    raise SchemaError(f"a property cannot be {value!r}")


def stored_props(values: dict) -> dict[str, tuple[str, str]]:
    return {str(k): stored_prop(v) for k, v in sorted(values.items())}


@dataclass(frozen=True)
class VerifyReport:
    lines: list[str]
    errors: list[str]


class Snapshot:
    """One version of the graph. Frames are lazy; methods with lists or numbers run a job."""

    def __init__(self, store: Store, version: Version | None = None, clock: Callable[[], int] = now_ns):
        self.store, self.clock = store, clock
        self.version = store.version() if version is None else version
        self.nodes, self.edges, self.log = store.read("nodes", self.version), store.edges(self.version), store.read("log", self.version)
        self.entering = store.edges(self.version, entering=True)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        pass

    # points

    def node_id(self, ext_id: str) -> int | None:
        found = self.nodes.where(F.col("ext_id") == ext_id).select("node_id").head(1)
        return found[0].node_id if found else None

    get_node_id = node_id

    def get_node(self, node_id: int) -> Node | None:
        found = self.nodes.where(F.col("node_id") == node_id).head(1)
        return Node.of(found[0]) if found else None

    def get_node_by_ext_id(self, ext_id: str) -> Node | None:
        found = self.nodes.where(F.col("ext_id") == ext_id).head(1)
        return Node.of(found[0]) if found else None

    def get_edge(self, edge_id: int) -> Edge | None:
        found = self.edges.where(F.col("edge_id") == edge_id).head(1)
        return Edge.of(found[0]) if found else None

    def view_edge(self, edge_id: int) -> Edge:
        """The edge, if it and both its ends exist."""
        found = self.edges.where(F.col("edge_id") == edge_id).head(1)
        if not found:
            raise InternalError(f"edge {edge_id} does not resolve")
        ends = {r.node_id for r in self.nodes.where(F.col("node_id").isin(found[0].from_id, found[0].to_id)).select("node_id").collect()}
        for side, end in (("from", found[0].from_id), ("to", found[0].to_id)):
            if end not in ends:
                raise InternalError(f"dangling {side}: {end}")
        return Edge.of(found[0])

    # frames

    def neighbors_frame(self, node: str, at=None) -> DataFrame:
        return temporal.in_order(temporal.neighbors(self.edges, node, instant(at, self.clock)))

    def reverse_neighbors_frame(self, node: str, at=None) -> DataFrame:
        return temporal.in_order(temporal.reverse_neighbors(self.entering, node, instant(at, self.clock)))

    def n_hops_frame(self, node: str, hops: int, at=None) -> DataFrame:
        return temporal.in_order(traverse.n_hops(self.edges, node, hops, instant(at, self.clock)), "depth", "path").select(*EDGES.names)

    def events_between(self, start=MIN_NS, end=MAX_NS) -> DataFrame:
        return diff.events_between(self.log, instant(start), instant(end)).orderBy("recorded_at_ns", "event_id")

    def all_nodes(self) -> DataFrame:
        return self.nodes.orderBy("node_id")

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("edge_id")

    def recorded_until(self, at) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as the log had them at a write time."""
        log = temporal.recorded_until(self.log, instant(at))
        return temporal.fold_nodes(log), temporal.fold_edges(log)

    def as_of_many(self, points: DataFrame) -> DataFrame:
        return temporal.as_of_many(self.edges, points)

    # lists

    def neighbors(self, node: str) -> list[Edge]:
        return self.neighbors_as_of(node)

    def neighbors_as_of(self, node: str, at=None) -> list[Edge]:
        return [Edge.of(r) for r in self.neighbors_frame(node, at).collect()]

    def reverse_neighbors_as_of(self, node: str, at=None) -> list[Edge]:
        return [Edge.of(r) for r in self.reverse_neighbors_frame(node, at).collect()]

    def n_hops_as_of(self, node: str, hops: int, at=None) -> list[Edge]:
        return [Edge.of(r) for r in self.n_hops_frame(node, hops, at).collect()]

    def path_as_of(self, source: str, target: str, at=None) -> list[Edge] | None:
        found = traverse.shortest_path(self.edges, source, target, instant(at, self.clock))
        return None if found is None else [Edge.of(r) for r in found.orderBy("step").collect()]

    def revision_chain(self, edge_id: int) -> list[Edge]:
        return [Edge.of(r) for r in traverse.revision_chain(self.edges, edge_id).orderBy("position").collect()]

    def diff_between(self, start, end) -> Result:
        a, b = instant(start), instant(end)
        return Result("diff", diff.diff_entries(self.log, a, b), diff.diff_summary(self.log, a, b))

    def stats(self) -> dict[str, int]:
        """Counts that every commit keeps; strings are the distinct types and sources in use."""
        c = self.version.counts
        names = self.edges.select("edge_type").union(self.edges.where("source <> ''").select("source")).union(self.nodes.where("node_type is not null").select("node_type"))
        return {"node_count": c["nodes"], "edge_count": c["edges"], "event_count": c["log"], "string_count": names.distinct().count()}

    def violations(self) -> DataFrame:
        return verify.violations(self.nodes, self.edges, self.log)

    def verify(self, most: int = 1000) -> VerifyReport:
        """What was checked, and the first ``most`` violations with the number of all; violations() has them as a frame."""
        missing = [f"meta key missing: {k}" for k in META_KEYS if k not in self.store.read_meta()]
        rows = self.violations()
        total = len(missing) + rows.count()
        found = missing + [f"{r.check} {r.id}: {r.detail}" for r in rows.orderBy("check", "id").limit(most).collect()]
        found += [f"and {total - len(found)} more"] if total > len(found) else []
        c = self.version.counts
        lines = ["container open OK", "meta: magic, version, features present" if not missing else "meta: see errors", "string interner: skipped, strings are inline", f"nodes: {c['nodes']} records verified", f"edges: {c['edges']} records verified", f"events: {c['log']} entries in strict order" if not any("event" in e for e in found) else "events: see errors", "edges agree with the log" if not any(e.startswith("fold") for e in found) else "edges: see errors", f"total errors: {total}"]
        return VerifyReport(lines, found)

    def compiler(self, strict_for_node: bool = False) -> Compiler:
        return Compiler(self.edges, self.nodes, self.log, self.clock, strict_for_node, self.entering)

    def run(self, query: str) -> Result:
        return self.compiler().run(query)


class WriteTxn:
    """A batch of writes on the driver, for transactions that fit there; see bulk_add_edges() for more. Reads see its own writes."""

    def __init__(self, store: Store, clock: Callable[[], int] = now_ns):
        self.store, self.clock, self.base = store, clock, store.version()
        self.last, self.at = dict(self.base.last), self.base.recorded_at_ns
        self.nodes: list[tuple] = []
        self.edges: dict[int, list] = {}
        self.cuts: list[tuple[int, int]] = []
        self.ends: dict[int, int] = {}  # of edges of the base that this batch has cut
        self.log: list[tuple] = []
        self.open = True
        self.known: dict[str, int | None] = {}
        self.all_known = self.base.counts["nodes"] <= FEW_NODES
        if self.all_known and self.base.counts["nodes"]:
            self.known = {r.ext_id: r.node_id for r in store.read("nodes", self.base).select("ext_id", "node_id").collect()}

    def __enter__(self) -> WriteTxn:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.commit() if kind is None else self.abort()

    def _next(self, what: str) -> int:
        self.last[what] += 1
        return self.last[what]

    def _record(self, kind: int, node=None, edge=None, edge_id=None, node_id=None, at=None) -> None:
        self.at = max(self.at, self.clock())
        self.log.append((self._next("event"), self.at, kind, node, edge, edge_id, node_id, at))

    def get_node_id(self, ext_id: str) -> int | None:
        if ext_id not in self.known and not self.all_known:
            found = self.store.read("nodes", self.base).where(F.col("ext_id") == ext_id).select("node_id").head(1)
            self.known[ext_id] = found[0].node_id if found else None
        return self.known.get(ext_id)

    def upsert_node(self, ext_id: str | NodeInput, node_type: str | None = None, properties: dict | None = None) -> int:
        """The node's id; type and properties count for a new one only."""
        given = ext_id if isinstance(ext_id, NodeInput) else NodeInput(ext_id, node_type, properties or {})
        if not given.ext_id:
            raise SchemaError("ext_id is empty")
        held = self.get_node_id(given.ext_id)
        if held is not None:
            return held
        props = stored_props(given.properties)
        row = (self._next("node"), given.ext_id, given.node_type or None, max(self.at, self.clock()), props)
        self.known[given.ext_id] = row[0]
        self.nodes.append(row)
        self._record(1, node=row)
        return row[0]

    def add_edge(self, from_: str | EdgeInput, to: str | None = None, edge_type: str | None = None, **rest) -> int:
        given = from_ if isinstance(from_, EdgeInput) else EdgeInput(from_, to, edge_type, **rest)
        if not given.edge_type:
            raise SchemaError("edge_type is empty")
        return self._add(given)

    def _add(self, given: EdgeInput, supersedes: int | None = None) -> int:
        start = instant(given.valid_from, self.clock)
        end = None if given.valid_to is None else instant(given.valid_to)
        seen = self.clock() if given.observed_at is None else instant(given.observed_at)
        if not given.from_ or not given.to:
            raise SchemaError("an edge needs both ends")
        if not 0 <= given.confidence <= 1:
            raise SchemaError(f"confidence out of range: {given.confidence}")
        if end is not None and end < start:
            raise SchemaError("valid_to before valid_from")
        props = stored_props(given.properties)
        ends = [(self.upsert_node(x), x) for x in (given.from_, given.to)]
        row = [self._next("edge"), *ends[0], *ends[1], given.edge_type or "", start, end, seen, given.source or "", float(given.confidence), supersedes, props]
        if supersedes is not None:
            self.invalidate_edge(supersedes, start)
        self.edges[row[0]] = row
        self._record(3, edge=tuple(row))
        if supersedes is not None:
            self._record(5, edge=tuple(row), edge_id=supersedes)
        return row[0]

    def _span(self, edge_id: int) -> tuple[int, int | None]:
        if edge_id in self.edges:
            return self.edges[edge_id][6], self.edges[edge_id][7]
        found = self.store.edges(self.base).where(F.col("edge_id") == edge_id).select("valid_from_ns", "valid_to_ns").head(1)
        if not found:
            raise NotFoundError(f"edge {edge_id}")
        return found[0].valid_from_ns, self.ends.get(edge_id, found[0].valid_to_ns)

    def invalidate_edge(self, edge_id: int, at: int | str) -> None:
        """End an edge at an instant; nothing happens if it ends by then already."""
        at = instant(at)
        start, end = self._span(edge_id)
        if end is not None and end <= at:
            return
        if at < start:
            raise SchemaError("valid_to before valid_from")
        if edge_id in self.edges:
            self.edges[edge_id][7] = at
        else:
            self.ends[edge_id] = at
            self.cuts.append((edge_id, at))
        self._record(4, edge_id=edge_id, at=at)

    def supersede_edge(self, old: int, given: EdgeInput) -> int:
        """End an edge where its replacement begins."""
        start, _ = self._span(old)
        given = EdgeInput(**(vars(given) | {"valid_from": instant(given.valid_from, self.clock)}))
        if given.valid_from < start and (self._span(old)[1] is None or self._span(old)[1] > given.valid_from):
            raise SchemaError("valid_to before valid_from")
        return self._add(given, old)

    def abort(self) -> None:
        self.open = False

    def commit(self) -> Version:
        if not self.open:
            raise InternalError("the transaction is over")
        self.open = False
        tables = {"nodes": (self.nodes, NODES), "edges": ([tuple(e) for e in self.edges.values()], EDGES), "cuts": (self.cuts, CUTS), "log": (self.log, EVENTS)}
        added = {t: len(rows) for t, (rows, _) in tables.items() if rows}
        if not added:
            return self.base

        def stage(table: str) -> str:
            rows, schema = tables[table]
            files = 1 + len(rows) // ROWS_A_FILE
            return self.store.stage(table, self.store.spark.createDataFrame(rows, schema, verifySchema=False).coalesce(files))

        with ThreadPoolExecutor(len(added)) as pool:  # the tables' jobs are small and do not depend on each other
            staged = dict(zip(added, pool.map(stage, added), strict=True))
        return self.store.publish(self.base, staged, added, self.last, self.at)


class Db:
    def __init__(self, path: str, spark: SparkSession | None = None, clock: Callable[[], int] = now_ns, create: bool = True):
        self.path, self.clock = path, clock
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.store = Store(self.spark, path, create)

    def read(self, version: int | None = None) -> Snapshot:
        return Snapshot(self.store, self.store.version(version), self.clock)

    def write(self) -> WriteTxn:
        return WriteTxn(self.store, self.clock)

    def read_with(self, f: Callable[[Snapshot], object]) -> object:
        return f(self.read())

    def write_with(self, f: Callable[[WriteTxn], object]) -> object:
        """What f returns; committed unless it raises."""
        with self.write() as w:
            return f(w)

    def run(self, query: str) -> Result:
        return self.read().run(query)

    def query(self, query: str) -> list[Edge] | None:
        """Edges of the result; None if there is no path. A diff has no edges: use query_json()."""
        result = self.run(query)
        if result.kind == "diff":
            raise ValueError("a diff has no edges; use query_json()")
        return [Edge.of(r) for r in result.rows.collect()] if result.found else None

    def query_json(self, query: str) -> str:
        return render.render_json(self.run(query)).rstrip("\n")

    def query_text(self, query: str) -> str:
        return render.render(self.run(query))


def write_all(db: Db, edges: Iterable[EdgeInput]) -> list[int]:
    with db.write() as w:
        return [w.add_edge(e) for e in edges]
