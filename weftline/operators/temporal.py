"""Edges at an instant, and states folded from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGES, NODES

ORDER = ("valid_from_ns", "edge_id")


def live(at_ns: int | Column) -> Column:
    """valid_from <= T < valid_to; the whole predicate is one that Parquet scans take."""
    t = at_ns if isinstance(at_ns, Column) else F.lit(at_ns)
    return (F.col("valid_from_ns") <= t) & (F.col("valid_to_ns").isNull() | (F.col("valid_to_ns") > t))


def as_of(edges: DataFrame, at_ns: int) -> DataFrame:
    return edges.where(live(at_ns))


def neighbors(edges: DataFrame, node: str, at_ns: int) -> DataFrame:
    """Live edges out of a node; unordered, see in_order()."""
    return edges.where((F.col("from_ext_id") == node) & live(at_ns))


def reverse_neighbors(edges: DataFrame, node: str, at_ns: int) -> DataFrame:
    return edges.where((F.col("to_ext_id") == node) & live(at_ns))


def connected(edges: DataFrame, node: str, at_ns: int, entering: DataFrame | None = None) -> DataFrame:
    """Live edges out of a node, then those into it, in column ``direction`` 0 and 1; a loop is in both.

    entering: another frame of the same edges to look for those into it.
    """
    out = neighbors(edges, node, at_ns).withColumn("direction", F.lit(0))
    return out.unionByName(reverse_neighbors(edges if entering is None else entering, node, at_ns).withColumn("direction", F.lit(1)))


def in_order(edges: DataFrame, *before: str, limit: int | None = None) -> DataFrame:
    """By the columns given, then valid_from and id; with a limit Catalyst takes the first rows without a full sort."""
    ordered = edges.orderBy(*before, *ORDER)
    return ordered if limit is None else ordered.limit(limit)


def as_of_many(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Live edges out of each (``ext_id``, ``at_ns``) of points: an as-of join on the node with the interval as residual."""
    t = F.col("at_ns")
    return points.join(edges, (edges["from_ext_id"] == points["ext_id"]) & live(t), "inner")


def fold_edges(log: DataFrame) -> DataFrame:
    """Edges as the log leaves them: valid_to is the least of the first one and of all invalidations, in any order.

    One aggregation by edge with partial sums; cut the log beforehand, see recorded_until(), for a past state.
    """
    edge = F.col("edge")
    seen = log.where(F.col("kind").isin(3, 4)).select(F.when(F.col("kind") == 3, edge["edge_id"]).otherwise(F.col("target_edge_id")).alias("__id"), F.when(F.col("kind") == 3, edge).alias("edge"), F.when(F.col("kind") == 4, F.col("at_ns")).alias("cut"))
    folded = seen.groupBy("__id").agg(F.first("edge", ignorenulls=True).alias("edge"), F.min("cut").alias("cut")).where("edge is not null")
    names = [f.name for f in EDGES]
    return folded.select(*(F.least(edge["valid_to_ns"], F.col("cut")).alias(n) if n == "valid_to_ns" else edge[n].alias(n) for n in names))


def fold_nodes(log: DataFrame) -> DataFrame:
    gone = log.where("kind = 2").select(F.col("target_node_id").alias("node_id"))
    added = log.where("kind = 1").select(*(F.col("node")[f.name].alias(f.name) for f in NODES))
    return added.join(gone, "node_id", "left_anti")


def recorded_until(log: DataFrame, at_ns: int | None = None, event_id: int | None = None) -> DataFrame:
    """The log as it was: system-time travel."""
    if at_ns is not None:
        log = log.where(F.col("recorded_at_ns") <= at_ns)
    return log if event_id is None else log.where(F.col("event_id") <= event_id)
