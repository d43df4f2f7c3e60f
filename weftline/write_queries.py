"""Queries that write: transactions and imports of rows from the test tables, and what graph they leave, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Db, EdgeInput
from .schema import EDGES
from .sources.importers import import_edges
from .sources.scratch import scratch_folder

DAY_NS = 86_400 * 10**9
#: The clock of these writes, 2026-06-01.
NOW_NS = 1_780_272_000 * 10**9
SUPPLIERS = 40


def _db(spark: SparkSession) -> Db:
    return Db(f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}", spark, clock=lambda: NOW_NS)


def written_graph(spark: SparkSession, sf_dir: str) -> Db:
    """Nations as nodes, the first suppliers as edges to theirs; then, in a second transaction, every third is ended and every
    fifth of the others replaced by one to the next nation. An aborted transaction and a refused row leave nothing."""
    nations = sorted(r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect())
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(F.col("s_suppkey") <= SUPPLIERS).select("s_suppkey", "s_nationkey").orderBy("s_suppkey").collect()
    db, made = _db(spark), {}
    with db.write() as w:
        for n in nations:
            w.upsert_node(f"nation:{n}", "nation")
        for s in suppliers:
            made[s.s_suppkey] = w.add_edge(f"supplier:{s.s_suppkey}", f"nation:{s.s_nationkey}", "LOCATED_IN", valid_from=s.s_suppkey * DAY_NS, source="supplier", confidence=s.s_suppkey % 8 / 8)
    lost = db.write()
    lost.add_edge("nobody", "nation:0", "LOCATED_IN")
    lost.abort()
    with db.write() as w:
        for s in suppliers:
            if s.s_suppkey % 3 == 0:
                w.invalidate_edge(made[s.s_suppkey], (s.s_suppkey + 1000) * DAY_NS)
            elif s.s_suppkey % 5 == 0:
                w.supersede_edge(made[s.s_suppkey], EdgeInput(f"supplier:{s.s_suppkey}", f"nation:{(s.s_nationkey + 1) % len(nations)}", "LOCATED_IN", (s.s_suppkey + 500) * DAY_NS, source="move"))
    return db


def written_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written_graph(spark, sf_dir).read().all_edges()
    return edges.select(*(F.col(c) for c in EDGES.names if c not in ("confidence", "props")), F.col("confidence").cast("double").alias("confidence"))


def written_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_graph(spark, sf_dir).read().all_nodes().drop("props")


def written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = written_graph(spark, sf_dir).read().events_between()
    return log.select("event_id", "recorded_at_ns", "kind", F.col("node.ext_id").alias("node"), F.col("edge.edge_id").alias("edge_id"), "target_edge_id", "at_ns")


# ---------------------------------------------------------------- imports


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows to import, as texts; by line number some are bad: 5 a confidence, 6 a time, 7 too few fields."""
    n = F.col("l_linenumber")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return items.select(
        n.alias("n"), F.concat(F.lit("order:"), "l_orderkey").alias("from"), F.concat(F.lit("part:"), "l_partkey").alias("to"), F.lit("CONTAINS").alias("edge_type"),
        F.when(n == 6, F.lit("soon")).otherwise(day).alias("valid_from"), F.when(n == 4, F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd")).otherwise(F.lit("")).alias("valid_to"),
        F.when(n == 5, F.lit("1.5")).otherwise(F.lit("0.5")).alias("confidence"),
    )


def _imported(spark: SparkSession, lines: DataFrame, kind: str) -> DataFrame:
    """What an import of these lines leaves: good edges by whether they end, nodes, and bad rows by reason."""
    path = f"{scratch_folder(spark)}/lines-{uuid.uuid4().hex}.{kind}"
    lines.write.text(path)
    db = _db(spark)
    done = import_edges(db.store, path, kind, now=NOW_NS)
    held = db.read()
    ended = F.when(F.col("valid_to_ns").isNull(), F.lit("open")).otherwise(F.lit("ended"))
    edges = held.edges.groupBy(ended.alias("what")).agg(F.count("*").alias("n"), F.min("valid_from_ns").alias("first"), F.max("valid_from_ns").alias("last"))
    ids = held.edges.agg(F.countDistinct("edge_id").alias("n"), F.min("edge_id").alias("first"), F.max("edge_id").alias("last")).select(F.lit("ids").alias("what"), "n", "first", "last")
    nodes = held.nodes.agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.max("node_id").alias("last")).select(F.lit("nodes").alias("what"), "n", "first", "last")
    none = F.lit(None).cast("long")
    bad = done.errors.groupBy(F.substring_index("error", ":", 1).alias("what")).agg(F.count("*").alias("n")).select("what", "n", none.alias("first"), none.alias("last"))
    return edges.union(ids).union(nodes).union(bad)


def imported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(",", "from", F.concat(F.lit('"'), "to", F.lit('"')), "edge_type", F.concat(F.lit(" "), "valid_from"), "valid_to", F.lit(""), F.lit("items"), "confidence")
    return _imported(spark, _items(spark, sf_dir).select(F.when(F.col("n") == 7, F.concat_ws(",", "from", "to")).otherwise(row)), "csv")


def imported_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).alias(name)

    row = F.struct("from", "to", F.when(F.col("n") != 7, F.col("edge_type")).alias("edge_type"), "valid_from", given("valid_to"), F.col("confidence").cast("double").alias("confidence"))
    return _imported(spark, _items(spark, sf_dir).select(F.to_json(row)), "jsonl")


QUERIES = {"written_edges": written_edges, "written_nodes": written_nodes, "written_log": written_log, "imported_csv": imported_csv, "imported_jsonl": imported_jsonl}

_WRITTEN = f"""
s AS (SELECT s_suppkey AS k, s_nationkey AS n, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier WHERE s_suppkey <= {SUPPLIERS}),
nn AS (SELECT count(*) AS c FROM nation),
nid AS (SELECT n_nationkey AS n, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation),
moved AS (SELECT *, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY k) AS e FROM s WHERE k % 5 = 0 AND k % 3 <> 0),
day AS (SELECT {DAY_NS}::BIGINT AS d),
edge AS (
  SELECT i AS edge_id, (SELECT c FROM nn) + i AS from_id, 'supplier:' || k AS from_ext_id, id AS to_id, 'nation:' || s.n AS to_ext_id, k * d AS valid_from_ns,
         CASE WHEN k % 3 = 0 THEN (k + 1000) * d WHEN k % 5 = 0 THEN (k + 500) * d END AS valid_to_ns, 'supplier' AS source, NULL::BIGINT AS supersedes, (k % 8) / 8.0::DOUBLE AS confidence
  FROM s JOIN nid ON nid.n = s.n, day
  UNION ALL SELECT e, (SELECT c FROM nn) + i, 'supplier:' || k, id, 'nation:' || nid.n, (k + 500) * d, NULL, 'move', i, 1.0 FROM moved JOIN nid ON nid.n = (moved.n + 1) % (SELECT c FROM nn), day)
"""
#: The order of events: nations; each supplier's node and edge; then by supplier an end, and for replaced ones the new edge and its link.
_EVENTS = f"""{_WRITTEN},
ev AS (
  SELECT 0 AS t, n_nationkey AS a, 0 AS b, 1 AS kind, 'nation:' || n_nationkey AS node, NULL::BIGINT AS edge_id, NULL::BIGINT AS target_edge_id, NULL::BIGINT AS at_ns FROM nation
  UNION ALL SELECT 1, k, 0, 1, 'supplier:' || k, NULL, NULL, NULL FROM s
  UNION ALL SELECT 1, k, 1, 3, NULL, i, NULL, NULL FROM s
  UNION ALL SELECT 2, k, 0, 4, NULL, NULL, i, CASE WHEN k % 3 = 0 THEN (k + 1000) * d ELSE (k + 500) * d END FROM s, day WHERE k % 3 = 0 OR k % 5 = 0
  UNION ALL SELECT 2, k, 1, 3, NULL, e, NULL, NULL FROM moved
  UNION ALL SELECT 2, k, 2, 5, NULL, e, i, NULL FROM moved)
SELECT row_number() OVER (ORDER BY t, a, b) AS event_id, {NOW_NS}::BIGINT AS recorded_at_ns, kind, node, edge_id, target_edge_id, at_ns FROM ev"""
_IMPORT = """WITH i AS (SELECT l_linenumber AS n, 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, epoch_ns(l_shipdate) AS t FROM lineitem),
good AS (SELECT * FROM i WHERE n NOT IN (5, 6, 7)),
nodes AS (SELECT count(*) AS c FROM (SELECT a FROM good UNION SELECT b FROM good))
SELECT CASE n WHEN 4 THEN 'ended' ELSE 'open' END AS what, count(*) AS n, min(t) AS first, max(t) AS last FROM good GROUP BY 1
UNION ALL SELECT 'ids', count(*), 1, count(*) FROM good
UNION ALL SELECT 'nodes', c, 1, c FROM nodes
UNION ALL SELECT CASE n WHEN 5 THEN 'confidence out of range' WHEN 6 THEN 'cannot parse valid_from' ELSE '{few}' END, count(*), NULL, NULL FROM i WHERE n IN (5, 6, 7) GROUP BY 1"""

SQL = {
    "written_edges": f"WITH {_WRITTEN} SELECT edge_id, from_id, from_ext_id, to_id, to_ext_id, 'LOCATED_IN' AS edge_type, valid_from_ns, valid_to_ns, {NOW_NS}::BIGINT AS observed_at_ns, source, supersedes, confidence FROM edge",
    "written_nodes": f"WITH {_WRITTEN} SELECT id AS node_id, 'nation:' || n AS ext_id, 'nation' AS node_type, {NOW_NS}::BIGINT AS created_at_ns FROM nid UNION ALL SELECT (SELECT c FROM nn) + i, 'supplier:' || k, NULL, {NOW_NS}::BIGINT FROM s",
    "written_log": f"WITH {_EVENTS}",
    "imported_csv": _IMPORT.replace("{few}", "expected at least 3 columns (from,to,edge_type), got 2"),
    "imported_jsonl": _IMPORT.replace("{few}", "missing \'\'edge_type\'\'"),
}
