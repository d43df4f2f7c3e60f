"""Breadth-first traversal of live edges, as level-wise joins.

A node's path is the array of (valid_from, edge_id) of its edges. Within a level, breadth-first order is the order of these
arrays, so the parent a queue would choose is the least array of each new node: a min aggregate. Edges leave nodes at a
depth below the number of hops, ordered by their source's depth and path, then by valid_from and id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .temporal import as_of

#: Up to so many hops are one lazy plan; beyond, levels are written out so that visited nodes are never expanded again.
UNROLLED = 4
#: A frontier of at most so many nodes is named in the scan's filter.
NAMED = 500
PATH = "array<struct<vf:bigint,id:bigint>>"


def _start(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(node).alias("node"), F.array().cast(PATH).alias("path"))


def _slim(edges: DataFrame, at_ns: int) -> DataFrame:
    return as_of(edges, at_ns).select(F.col("from_ext_id").alias("node"), F.col("to_ext_id").alias("next"), F.struct(F.col("valid_from_ns").alias("vf"), F.col("edge_id").alias("id")).alias("step"))


def _expand(slim: DataFrame, frontier: DataFrame) -> DataFrame:
    """The nodes one edge further, each with its least path; visited ones included."""
    return slim.join(frontier, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("step"))).alias("path"))


def _step(slim: DataFrame, frontier: DataFrame) -> DataFrame:
    """_expand() of a frontier that is written out. The names of a small one go into the scan, which then skips row groups of
    edges clustered by node; a larger one is joined."""
    names = [r.node for r in frontier.select("node").limit(NAMED + 1).collect()]
    return _expand(slim.where(F.col("node").isin(names)) if len(names) <= NAMED else slim, frontier)


def reached(edges: DataFrame, start: str, depth: int, at_ns: int, unrolled: int = UNROLLED) -> DataFrame:
    """``node, path`` of all nodes at most ``depth`` edges from start.

    Up to ``unrolled`` edges that is one lazy plan with a scan for each level; with 0, every level is a job of its own, which on
    a large graph in clustered files reads only what the level needs.
    """
    slim = _slim(edges, at_ns)
    if depth <= unrolled:
        level = _start(edges, start)
        every = level
        for _ in range(depth):
            level = _expand(slim, level)
            every = every.union(level)
        shortest = every.groupBy("node").agg(F.min(F.struct(F.size("path").alias("depth"), "path")).alias("best"))
        return shortest.select("node", "best.path")
    level = written(_start(edges, start))
    every = level
    for _ in range(depth):
        level = written(_step(slim, level).join(every.select("node"), "node", "left_anti"))
        if not level.head(1):
            break
        every = every.union(level)
    return every


def n_hops(edges: DataFrame, start: str, hops: int, at_ns: int, unrolled: int = UNROLLED) -> DataFrame:
    """Live edges out of nodes fewer than ``hops`` edges from start, with ``depth`` and ``path`` of their source to sort by."""
    live = as_of(edges, at_ns)
    if hops <= 0:
        return live.limit(0).withColumn("depth", F.lit(0)).withColumn("path", F.array().cast(PATH))
    found = reached(edges, start, hops - 1, at_ns, unrolled).select(F.col("node").alias("from_ext_id"), F.size("path").alias("depth"), "path")
    return live.join(found, "from_ext_id").select(*edges.columns, "depth", "path")


def shortest_path(edges: DataFrame, source: str, target: str, at_ns: int, longest: int | None = None) -> DataFrame | None:
    """Edges of the path with fewest edges, with ``step`` from 0; no edge if source is target; None if there is no path.

    One job for each level, stopped at the target. Ties go to the path a breadth-first search finds first.
    """
    none = edges.limit(0).withColumn("step", F.lit(0))
    if source == target:
        return none
    slim = _slim(edges, at_ns)
    level = written(_start(edges, source))
    every, depth = level, 0
    while longest is None or depth < longest:
        level = written(_step(slim, level).join(every.select("node"), "node", "left_anti"))
        depth += 1
        found = level.where(F.col("node") == target).select("path").head(1)
        if found:
            ids = [s.id for s in found[0].path]
            order = F.array_position(F.lit(ids), F.col("edge_id")) - 1
            return edges.where(F.col("edge_id").isin(ids)).withColumn("step", order.cast("int"))
        if not level.head(1):
            return None
        every = every.union(level)
    return None


def bounded_path(edges: DataFrame, source: str, target: str, at_ns: int, longest: int = UNROLLED) -> DataFrame:
    """shortest_path() of at most ``longest`` edges as one lazy plan; no row if there is none."""
    best = reached(edges, source, longest, at_ns).where(F.col("node") == target).select(F.posexplode("path").alias("step", "at"))
    return edges.join(best.select("step", F.col("at.id").alias("edge_id")), "edge_id").select(*edges.columns, "step")


def revision_chain(edges: DataFrame, edge_id: int) -> DataFrame:
    """The edge and the ones it replaces, ``position`` from 0; no row if it does not exist; loops are cut off where they close.

    Only ids of edges that replace another take part, from a narrow copy. A round knows the chain's first 4^r ids and, for every edge,
    the one 4^r steps on; three joins of the two make the next round's, so a chain of any length takes a logarithm of rounds.
    """
    spark = edges.sparkSession
    jump = written(edges.where("supersedes IS NOT NULL").select("edge_id", F.col("supersedes").alias("to")), "links")
    known = spark.range(1).select(F.lit(edge_id).cast("long").alias("edge_id"), F.lit(0).cast("long").alias("position"))
    count, step = 1, 1
    while True:
        ahead = [known]
        for _ in range(3):
            ahead.append(ahead[-1].join(jump, "edge_id").select(F.col("to").alias("edge_id"), (F.col("position") + step).alias("position")))
        known = written(reduce(DataFrame.union, ahead).groupBy("edge_id").agg(F.min("position").alias("position")), "chain")
        step, before, count = 4 * step, count, known.count()
        if count < 4 * before:  # it ended, or came back to an id it has
            break
        far = jump
        for _ in range(3):
            far = far.join(jump.select(F.col("edge_id").alias("to"), F.col("to").alias("next")), "to").select("edge_id", F.col("next").alias("to"))
        old, jump = jump, written(far, "links")
        discard(old)
    return edges.join(known, "edge_id").select(*edges.columns, F.col("position").cast("int").alias("position"))
