"""Queries over the order graph and the event log, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import conjunction
from .operators import diff, temporal, traverse, verify
from .plans.compiler import Compiler
from .schema import EDGES, NODES, PROPS
from .sources.fixtures import T_NS, event_log, order_sequence, purchase_chains, purchase_log, sequence_ends, stored_order_graph
from .write_queries import SQL as WRITE_SQL
from .write_queries import QUERIES as WRITE_QUERIES

VIEW = [c for c in EDGES.names if c not in ("from_id", "to_id", "confidence", "supersedes", "props")]
TEXT_T = "1999-01-01T00:00:00Z"
#: Bounds for the log, which holds January 2024.
LOG_FROM, LOG_TO = "2024-01-08T00:00:00Z", "2024-01-22T12:00:00Z"
#: 2033, when all orders are placed.
LATE_NS = 2_000_000_000 * 10**9
LOG_NS = (1_704_672_000 * 10**9, 1_705_924_800 * 10**9)
_starts: dict[str, tuple[str, str]] = {}


def start_of(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The customer with most live orders, least key first, and the nation with the least key a supplier is in."""
    if sf_dir not in _starts:
        live = stored_order_graph(spark, sf_dir).where("edge_type = 'PLACED'").where(temporal.live(T_NS))
        best = live.groupBy("from_id").count().orderBy(F.desc("count"), "from_id").first()
        nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.min("s_nationkey")).first()[0]
        _starts[sf_dir] = (f"customer:{best.from_id}", f"nation:{nation}")
    return _starts[sf_dir]


def view(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(*VIEW, F.round(F.col("confidence").cast("double"), 4).alias("confidence"), *more)


def _on_graph(f: Callable[[DataFrame, str, str], DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(f(stored_order_graph(spark, sf_dir), *start_of(spark, sf_dir)), *more)


def _where(*term) -> Callable[[SparkSession, str], DataFrame]:
    return _on_graph(lambda g, s, _: temporal.connected(g, s, T_NS).where(conjunction([term])))


def _everywhere(*term) -> Callable[[SparkSession, str], DataFrame]:
    """A WHERE over all live edges: how many, by type."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return temporal.as_of(stored_order_graph(spark, sf_dir), T_NS).where(conjunction([term])).groupBy("edge_type").agg(F.count("*").alias("n"), F.sum(F.pmod("edge_id", F.lit(1_000_003))).alias("ids"))

    return run


def _dsl(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        start, nation = start_of(spark, sf_dir)
        result = Compiler(stored_order_graph(spark, sf_dir), None, event_log(spark, sf_dir)).run(text.format(start=start, nation=nation))
        return _entries(result.rows) if result.kind == "diff" else view(result.rows)

    return run


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "at_ns", "event_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ends of the order graph but the nations."""
    edges = stored_order_graph(spark, sf_dir)
    ends = edges.select(F.col("from_id").alias("node_id"), F.col("from_ext_id").alias("ext_id")).union(edges.select("to_id", "to_ext_id")).distinct()
    return ends.where("ext_id not like 'nation:%'").select("node_id", "ext_id", F.split("ext_id", ":")[0].alias("node_type"), F.lit(0).cast("long").alias("created_at_ns"), F.create_map().cast(PROPS).alias("props")).select(*NODES.names)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, log = stored_order_graph(spark, sf_dir), event_log(spark, sf_dir)
    nodes = edges.select("from_ext_id").union(edges.select("to_ext_id")).distinct()
    strings = edges.select(F.explode(F.array("edge_type", "source")).alias("s")).where("s <> ''").distinct()
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("nodes", nodes), ("edges", edges), ("events", log), ("strings", strings))]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, at the instant of the last order: the edges live then."""
    edges = stored_order_graph(spark, sf_dir)
    points = edges.where("edge_type = 'PLACED'").groupBy(F.col("from_ext_id").alias("ext_id")).agg(F.max("valid_from_ns").alias("at_ns"))
    return temporal.as_of_many(edges, points).groupBy("ext_id", "at_ns").agg(F.count("*").alias("n"), F.min("edge_id").alias("least"), F.max("edge_id").alias("most"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = purchase_chains(spark, sf_dir)
    last = edges.groupBy("from_id").agg(F.count("*").alias("n"), F.max_by("edge_id", "valid_from_ns").alias("last")).orderBy(F.desc("n"), "from_id").first()["last"]
    return view(traverse.revision_chain(edges, last), "position")


def _path_found(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Whether shortest_path() finds a path, and its number of edges; null if there is none."""
    path = traverse.shortest_path(edges, source, target, T_NS)
    if path is None:
        return edges.sparkSession.range(1).select(F.lit(False).alias("found"), F.lit(None).cast("long").alias("steps"))
    return path.agg(F.count("*").alias("steps")).select(F.lit(True).alias("found"), "steps")


def verify_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by check in the order graph and the log with faults put in: inverted spans, confidences and ids out of place,
    ends that are no nodes, gaps in the log, and events recorded too early."""
    key = F.pmod("edge_id", F.lit(1009))
    edges = stored_order_graph(spark, sf_dir)
    bad = edges.withColumn("valid_to_ns", F.when(key == 1, F.col("valid_from_ns") - 1).otherwise(F.col("valid_to_ns")))
    bad = bad.withColumn("confidence", F.when(key == 2, F.lit(1.5)).when(key == 3, F.lit(None)).otherwise(F.col("confidence")).cast("float"))
    bad = bad.unionByName(edges.where(key == 4))
    log = event_log(spark, sf_dir).where("event_id % 7 <> 0")
    log = log.withColumn("recorded_at_ns", (F.col("event_id") - F.when(F.col("event_id") % 501 == 0, 5).otherwise(0)) * 10**9)
    found = verify.violations(_nodes(spark, sf_dir), bad, log, check_fold=False)
    return found.groupBy("check").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    hops = lambda h: _on_graph(lambda g, s, _: traverse.n_hops(g, s, h, T_NS))
    at = f' AT "{TEXT_T}"'
    return {
        "neighbors_as_of": _on_graph(lambda g, s, _: temporal.neighbors(g, s, T_NS)),
        "reverse_neighbors_as_of": _on_graph(lambda g, _, n: temporal.reverse_neighbors(g, n, T_NS)),
        "who_connected": _on_graph(lambda g, _, n: temporal.connected(g, n, T_NS), "direction"),
        "as_of_all": lambda spark, d: temporal.as_of(stored_order_graph(spark, d), T_NS).groupBy("edge_type").agg(F.count("*").alias("n"), F.min("valid_from_ns").alias("first"), F.max("valid_to_ns").alias("last")),
        "as_of_many": as_of_many,
        "neighbors_where_type": _where("type", "=", "PLACED"),
        "neighbors_where_source": _where("source", ">=", "3"),
        "neighbors_where_confidence_f32": _everywhere("confidence", ">=", 0.9),
        "neighbors_where_valid_from": _everywhere("valid_from", "<", "1997-01-01"),
        "neighbors_where_valid_to_open": _everywhere("valid_to", ">=", "2300-01-01T00:00:00Z"),
        "neighbors_where_observed_at": _everywhere("observed_at", "!=", "1970-01-01"),
        "neighbors_limit": _on_graph(lambda g, s, _: temporal.in_order(temporal.neighbors(g, s, T_NS), limit=5)),
        "hops_1": hops(1),
        "hops_2": hops(2),
        "hops_3": hops(3),
        "hops_4": hops(4),
        "hops_where_after": _on_graph(lambda g, s, _: traverse.n_hops(g, s, 3, T_NS).where(conjunction([("type", "=", "SUPPLIED_BY"), ("confidence", "<", 0.5)]))),
        "hops_limit_bfs_order": _on_graph(lambda g, s, _: temporal.in_order(traverse.n_hops(g, s, 3, T_NS), "depth", "path", limit=25)),
        "shortest_path": _on_graph(lambda g, s, n: traverse.bounded_path(g, s, n, T_NS), "step"),
        "shortest_path_where": _on_graph(lambda g, s, n: traverse.bounded_path(g, s, n, T_NS).where(conjunction([("type", "!=", "CONTAINS")])), "step"),
        "path_self": lambda spark, d: _path_found(stored_order_graph(spark, d), *[start_of(spark, d)[0]] * 2),
        "path_none": lambda spark, d: _path_found(stored_order_graph(spark, d), *reversed(start_of(spark, d))),
        "shortest_path_unbounded": lambda spark, d: view(traverse.shortest_path(order_sequence(spark, d), *sequence_ends(spark, d), LATE_NS), "step"),
        "hops_6": lambda spark, d: view(traverse.n_hops(order_sequence(spark, d), sequence_ends(spark, d)[0], 6, LATE_NS)),
        "verify_planted": verify_planted,
        "diff_entries": lambda spark, d: _entries(diff.diff_entries(event_log(spark, d), *LOG_NS)),
        "diff_summary": lambda spark, d: diff.diff_summary(event_log(spark, d), *LOG_NS),
        "what_changed": lambda spark, d: Compiler(stored_order_graph(spark, d), None, event_log(spark, d)).run(f'WHAT CHANGED BETWEEN "{LOG_FROM}" AND "{LOG_TO}" FOR NODE "any"').summary,
        "events_between": lambda spark, d: diff.events_between(event_log(spark, d), *LOG_NS).select("event_id", "recorded_at_ns", "kind", "target_node_id"),
        "edge_state_fold": lambda spark, d: view(temporal.fold_edges(purchase_log(spark, d))),
        "edge_state_as_recorded": lambda spark, d: view(temporal.fold_edges(temporal.recorded_until(purchase_log(spark, d), LOG_NS[1]))),
        "revision_chain": chain,
        "stats": stats,
        "all_nodes": lambda spark, d: _nodes(spark, d).select("node_id", "ext_id", "node_type").orderBy("ext_id"),
        "all_edges": lambda spark, d: view(stored_order_graph(spark, d)).orderBy("edge_id"),
        "verify_dangling": lambda spark, d: verify.dangling(stored_order_graph(spark, d), _nodes(spark, d)).groupBy("check").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")),
        "dsl_neighbors": _dsl('FIND NEIGHBORS OF "{start}"' + at + ' WHERE type = "PLACED" AND confidence >= 0.2 LIMIT 10'),
        "dsl_hops": _dsl('find 2 hops from "{start}" before "1999-01-01" where source != "x"'),
        "dsl_path": _dsl('SHOW PATH FROM "{start}" TO "{nation}"' + at),
        "dsl_who": _dsl('WHO WAS CONNECTED TO "{nation}" ON "1999-01-01" WHERE valid_to > "2020-01-01"'),
        "dsl_diff": _dsl(f'DIFF GRAPH BETWEEN "{LOG_FROM}" AND "{LOG_TO}"'),
        **WRITE_QUERIES,
    }


# ---------------------------------------------------------------- SQL

_GRAPH = """
items AS (SELECT l_orderkey, l_partkey, l_suppkey, epoch_ns(l_shipdate) AS ship FROM lineitem),
parts AS (
  SELECT 1000000000000 + o_orderkey AS edge_id, 'customer:' || o_custkey AS from_ext_id, 'order:' || o_orderkey AS to_ext_id, 'PLACED' AS edge_type, epoch_ns(o_orderdate) AS valid_from_ns,
         CASE WHEN o_orderstatus = 'F' THEN greatest(epoch_ns(o_orderdate), s.last) END AS valid_to_ns, lower(o_orderpriority) AS source, o_custkey AS from_id, o_orderkey AS to_id
  FROM orders JOIN (SELECT l_orderkey, max(ship) AS last FROM items GROUP BY 1) s ON l_orderkey = o_orderkey
  UNION ALL SELECT 2000000000000 + l_orderkey * 1000000 + l_partkey, 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', min(ship), NULL, 'lineitem', l_orderkey, l_partkey FROM items GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 3000000000000000 + l_partkey * 1000000 + l_suppkey, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', min(ship), NULL, 'lineitem', l_partkey, l_suppkey FROM items GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 4000000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 0, NULL, 'lineitem', s_suppkey, s_nationkey FROM supplier),
g AS (SELECT *, valid_from_ns AS observed_at_ns, ((edge_id % 101) / 100.0)::FLOAT AS conf FROM parts),
live AS (SELECT * FROM g WHERE valid_from_ns <= {t} AND (valid_to_ns IS NULL OR valid_to_ns > {t})),
start AS (SELECT from_ext_id AS node FROM live WHERE edge_type = 'PLACED' GROUP BY from_ext_id, from_id ORDER BY count(*) DESC, from_id LIMIT 1),
nation0 AS (SELECT 'nation:' || min(s_nationkey) AS node FROM supplier),
walks(depth, node, path) AS (
  SELECT 0, node, []::STRUCT(vf BIGINT, id BIGINT)[] FROM start
  UNION ALL SELECT depth + 1, l.to_ext_id, list_append(path, {{'vf': l.valid_from_ns, 'id': l.edge_id}}) FROM walks w JOIN live l ON l.from_ext_id = w.node WHERE depth < 4),
reach AS (SELECT node, min({{'depth': depth, 'path': path}}) AS best FROM walks GROUP BY node)
""".format(t=T_NS)  # fmt: skip
_VIEW = "edge_id, from_ext_id, to_ext_id, edge_type, valid_from_ns, valid_to_ns, observed_at_ns, source, round(conf::DOUBLE, 4) AS confidence"
_HOPS = "FROM live JOIN reach ON reach.node = from_ext_id WHERE best.depth < {h}"
_COUNT = "SELECT edge_type, count(*) AS n, sum(edge_id % 1000003)::BIGINT AS ids FROM live WHERE {w} GROUP BY edge_type"
_BOTH = f"SELECT {_VIEW} FROM (SELECT * FROM live WHERE from_ext_id = (SELECT node FROM {{n}}) UNION ALL SELECT * FROM live WHERE to_ext_id = (SELECT node FROM {{n}})) WHERE {{w}}"
_PATH = f"SELECT {_VIEW}, step::INTEGER AS step FROM (SELECT unnest(best.path).id AS id, unnest(range(len(best.path))) AS step FROM reach WHERE node = (SELECT node FROM nation0)) JOIN g ON id = edge_id"
#: Walks of any length from the nation; the graph leads nowhere from there.
_BACK = """walks2(depth, node) AS (
  SELECT 0, node FROM nation0 UNION SELECT depth + 1, l.to_ext_id FROM walks2 w JOIN live l ON l.from_ext_id = w.node),
back AS (SELECT node, {'depth': min(depth)} AS best FROM walks2 GROUP BY node),
"""
_SEQUENCE = """
o AS (SELECT o_custkey, o_orderkey, epoch_ns(o_orderdate) AS t, row_number() OVER w AS i, lead(o_orderkey, 1) OVER w AS nx, lead(o_orderkey, 2) OVER w AS af FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
top AS (SELECT arg_min(o_orderkey, {'t': o_orderdate, 'k': o_orderkey}) AS a, max({'t': o_orderdate, 'k': o_orderkey}) AS b FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1),
e AS (SELECT o_orderkey + 5000000000000000 AS edge_id, o_orderkey AS a, nx AS b, 'NEXT' AS edge_type, t FROM o WHERE nx IS NOT NULL
      UNION ALL SELECT o_orderkey + 6000000000000000, o_orderkey, af, 'LEAP', t FROM o WHERE af IS NOT NULL AND i % 3 = 1),
g AS (SELECT edge_id, 'order:' || a AS from_ext_id, 'order:' || b AS to_ext_id, edge_type, t AS valid_from_ns, NULL::BIGINT AS valid_to_ns, t AS observed_at_ns, 'lineitem' AS source, ((edge_id % 101) / 100.0)::FLOAT AS conf FROM e),
walks(node, path) AS (
  SELECT 'order:' || a, []::STRUCT(vf BIGINT, id BIGINT)[] FROM top
  UNION ALL SELECT g.to_ext_id, list_append(path, {'vf': valid_from_ns, 'id': edge_id}) FROM walks w JOIN g ON g.from_ext_id = w.node)
"""
_PLANTED = """,
bad AS (SELECT edge_id, to_ext_id, valid_from_ns, CASE WHEN edge_id % 1009 = 1 THEN valid_from_ns - 1 ELSE valid_to_ns END AS valid_to_ns, CASE edge_id % 1009 WHEN 2 THEN 1.5 WHEN 3 THEN NULL ELSE conf END AS c FROM g
        UNION ALL SELECT edge_id, to_ext_id, valid_from_ns, valid_to_ns, conf FROM g WHERE edge_id % 1009 = 4),
l AS (SELECT event_id, (event_id - CASE WHEN event_id % 501 = 0 THEN 5 ELSE 0 END) * 1000000000 AS r FROM events WHERE event_id % 7 <> 0),
v AS (
  SELECT 'inverted' AS "check", edge_id AS id FROM bad WHERE valid_to_ns < valid_from_ns
  UNION ALL SELECT 'confidence', edge_id FROM bad WHERE c IS NULL OR c NOT BETWEEN 0 AND 1
  UNION ALL SELECT 'edge_id_repeated', edge_id FROM bad GROUP BY edge_id HAVING count(*) > 1
  UNION ALL SELECT 'to_missing', edge_id FROM bad WHERE to_ext_id LIKE 'nation:%'
  UNION ALL SELECT 'event_order', event_id FROM (SELECT event_id, r, max(r) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l) WHERE r < m
  UNION ALL SELECT 'ext_id_repeated', min(node_id) FROM (SELECT DISTINCT node_id, ext_id FROM (SELECT from_id AS node_id, from_ext_id AS ext_id FROM g UNION ALL SELECT to_id, to_ext_id FROM g) WHERE ext_id NOT LIKE 'nation:%') GROUP BY ext_id HAVING count(*) > 1
  UNION ALL SELECT 'node_id_repeated', node_id FROM (SELECT DISTINCT node_id, ext_id FROM (SELECT from_id AS node_id, from_ext_id AS ext_id FROM g UNION ALL SELECT to_id, to_ext_id FROM g) WHERE ext_id NOT LIKE 'nation:%') GROUP BY node_id HAVING count(*) > 1)
SELECT "check", count(*) AS n, min(id) AS least, max(id) AS most FROM v GROUP BY 1"""
_KIND = "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'click' THEN 5 ELSE 6 END"
_LOG = f"log AS (SELECT event_id, epoch_ns(ts) AS at_ns, {_KIND} AS k, user_id FROM events WHERE epoch_ns(ts) BETWEEN {LOG_NS[0]} AND {LOG_NS[1]})"
_ENTRIES = f"WITH {_LOG} SELECT CASE k WHEN 1 THEN 'node_added' WHEN 3 THEN 'edge_added' WHEN 4 THEN 'edge_invalidated' WHEN 5 THEN 'edge_superseded' ELSE 'property_set' END AS kind, at_ns, event_id FROM log"
_SUMMARY = f"WITH {_LOG} SELECT count(*) FILTER (k = 1) AS nodes_added, count(*) FILTER (k = 2) AS nodes_removed, count(*) FILTER (k = 3) AS edges_added, count(*) FILTER (k = 4) AS edges_invalidated, count(*) FILTER (k = 5) AS edges_superseded, count(*) FILTER (k = 6) AS properties_updated FROM log"
_FOLD = """WITH e AS (SELECT event_id, user_id, event_type, epoch_ns(ts) AS t FROM events),
first AS (SELECT user_id, min(t) AS start, arg_min(event_id, t) AS event_id FROM e WHERE event_type = 'purchase' GROUP BY 1),
cuts AS (SELECT e.user_id, min(t) AS cut FROM e JOIN first f ON f.user_id = e.user_id WHERE event_type = 'error' AND t >= start AND t <= {until} GROUP BY 1)
SELECT f.user_id AS edge_id, 'user:' || f.user_id AS from_ext_id, 'event:' || f.event_id AS to_ext_id, 'BOUGHT' AS edge_type, start AS valid_from_ns, cut AS valid_to_ns, start AS observed_at_ns, 'lineitem' AS source,
       round(((f.user_id % 101) / 100.0)::FLOAT::DOUBLE, 4) AS confidence
FROM first f LEFT JOIN cuts c ON c.user_id = f.user_id WHERE start <= {until}"""
_CHAIN = """WITH RECURSIVE p AS (SELECT event_id, user_id, epoch_ns(ts) AS t, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type = 'purchase'),
top AS (SELECT arg_max(event_id, t) AS id FROM p GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
c(id, position) AS (SELECT id, 0 FROM top UNION ALL SELECT p.before, position + 1 FROM c JOIN p ON p.event_id = c.id WHERE p.before IS NOT NULL)
SELECT event_id AS edge_id, 'user:' || user_id AS from_ext_id, 'event:' || event_id AS to_ext_id, 'BOUGHT' AS edge_type, t AS valid_from_ns, NULL::BIGINT AS valid_to_ns, t AS observed_at_ns, 'lineitem' AS source,
       round(((event_id % 101) / 100.0)::FLOAT::DOUBLE, 4) AS confidence, position FROM c JOIN p ON p.event_id = c.id"""


def oracle_sql() -> dict[str, str]:
    def graph(sql: str) -> str:
        return f"WITH RECURSIVE {_GRAPH} {sql}"

    def both(n: str, w: str = "true") -> str:
        return graph(_BOTH.format(n=n, w=w))

    def hops(h: int, w: str = "true", tail: str = "") -> str:
        return graph(f"SELECT {_VIEW} {_HOPS.format(h=h)} AND {w} {tail}")

    def count(w: str) -> str:
        return graph(_COUNT.format(w=w))

    from_start = f"SELECT {_VIEW} FROM live WHERE from_ext_id = (SELECT node FROM start)"
    nodes = "SELECT DISTINCT node_id, ext_id, split_part(ext_id, ':', 1) AS node_type FROM (SELECT from_id AS node_id, from_ext_id AS ext_id FROM g UNION ALL SELECT to_id, to_ext_id FROM g) WHERE ext_id NOT LIKE 'nation:%'"
    return {
        "neighbors_as_of": graph(from_start),
        "reverse_neighbors_as_of": graph(f"SELECT {_VIEW} FROM live WHERE to_ext_id = (SELECT node FROM nation0)"),
        "who_connected": graph(f"SELECT {_VIEW}, 0 AS direction FROM live WHERE from_ext_id = (SELECT node FROM nation0) UNION ALL SELECT {_VIEW}, 1 FROM live WHERE to_ext_id = (SELECT node FROM nation0)"),
        "as_of_all": graph("SELECT edge_type, count(*) AS n, min(valid_from_ns) AS first, max(valid_to_ns) AS last FROM live GROUP BY edge_type"),
        "as_of_many": graph("SELECT ext_id, at_ns, count(*) AS n, min(edge_id) AS least, max(edge_id) AS most FROM (SELECT from_ext_id AS ext_id, max(valid_from_ns) AS at_ns FROM g WHERE edge_type = 'PLACED' GROUP BY 1) p JOIN g ON from_ext_id = ext_id AND valid_from_ns <= at_ns AND (valid_to_ns IS NULL OR valid_to_ns > at_ns) GROUP BY 1, 2"),
        "neighbors_where_type": both("start", "edge_type = 'PLACED'"),
        "neighbors_where_source": both("start", "source >= '3'"),
        "neighbors_where_confidence_f32": count("conf >= 0.9::FLOAT"),
        "neighbors_where_valid_from": count("valid_from_ns < 852076800::BIGINT * 1000000000"),
        "neighbors_where_valid_to_open": count("valid_to_ns IS NULL"),
        "neighbors_where_observed_at": count("observed_at_ns <> 0"),
        "neighbors_limit": graph(from_start + " ORDER BY valid_from_ns, edge_id LIMIT 5"),
        "hops_1": hops(1),
        "hops_2": hops(2),
        "hops_3": hops(3),
        "hops_4": hops(4),
        "hops_where_after": hops(3, "edge_type = 'SUPPLIED_BY' AND conf < 0.5::FLOAT"),
        "hops_limit_bfs_order": hops(3, tail="ORDER BY best.depth, best.path, valid_from_ns, edge_id LIMIT 25"),
        "shortest_path": graph(_PATH),
        "shortest_path_where": graph(f"SELECT * FROM ({_PATH}) WHERE edge_type <> 'CONTAINS'"),
        "path_self": graph("SELECT count(*) > 0 AS found, min(best.depth)::BIGINT AS steps FROM reach WHERE node = (SELECT node FROM start)"),
        "path_none": graph("SELECT count(*) > 0 AS found, min(best.depth)::BIGINT AS steps FROM reach WHERE node = (SELECT node FROM start)".replace("reach", "back")).replace("reach AS (", _BACK + "reach AS ("),
        "shortest_path_unbounded": f"WITH RECURSIVE {_SEQUENCE} SELECT {_VIEW}, step::INTEGER AS step FROM (SELECT unnest(best).id AS id, unnest(range(len(best))) AS step FROM (SELECT arg_min(path, {{'n': len(path), 'path': path}}) AS best FROM walks WHERE node = (SELECT 'order:' || b.k FROM top))) JOIN g ON id = edge_id",
        "hops_6": f"WITH RECURSIVE {_SEQUENCE} SELECT DISTINCT {_VIEW} FROM g JOIN walks ON node = from_ext_id WHERE len(path) < 6",
        "verify_planted": f"WITH RECURSIVE {_GRAPH}{_PLANTED}",
        "diff_entries": _ENTRIES,
        "diff_summary": _SUMMARY,
        "what_changed": _SUMMARY,
        "events_between": f"WITH {_LOG} SELECT event_id, at_ns AS recorded_at_ns, k AS kind, user_id AS target_node_id FROM log",
        "edge_state_fold": _FOLD.format(until=(1 << 63) - 1),
        "edge_state_as_recorded": _FOLD.format(until=LOG_NS[1]),
        "revision_chain": _CHAIN,
        "stats": graph("SELECT 'nodes' AS what, count(*) AS n FROM (SELECT from_ext_id FROM g UNION SELECT to_ext_id FROM g) UNION ALL SELECT 'edges', count(*) FROM g UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'strings', count(*) FROM (SELECT edge_type AS s FROM g UNION SELECT source FROM g WHERE source <> '')"),
        "all_nodes": graph(nodes),
        "all_edges": graph(f"SELECT {_VIEW} FROM g"),
        "verify_dangling": graph("SELECT 'to_missing' AS \"check\", count(*) AS n, min(edge_id) AS least, max(edge_id) AS most FROM g WHERE to_ext_id LIKE 'nation:%'"),
        "dsl_neighbors": graph(from_start + " AND edge_type = 'PLACED' AND conf >= 0.2::FLOAT ORDER BY valid_from_ns, edge_id LIMIT 10"),
        "dsl_hops": hops(2),
        "dsl_path": graph(f"SELECT * EXCLUDE (step) FROM ({_PATH})"),
        "dsl_who": both("nation0", "coalesce(valid_to_ns, 9223372036854775807) > 1577836800::BIGINT * 1000000000"),
        "dsl_diff": _ENTRIES,
        **WRITE_SQL,
    }
