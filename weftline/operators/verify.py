"""Integrity checks as DataFrames of violations: ``check, id, detail``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGES
from .temporal import fold_edges


def _found(df: DataFrame, check: str, key: str, detail: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(key).cast("long").alias("id"), F.lit(detail).alias("detail"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node, one row for each such end."""
    out = []
    for side in ("from", "to"):
        ids = nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("ext_id").alias(f"{side}_ext_id"))
        out.append(_found(edges.join(ids, [f"{side}_id", f"{side}_ext_id"], "left_anti"), f"{side}_missing", "edge_id", f"edge's {side} is no node"))
    return out[0].union(out[1])


def out_of_order(log: DataFrame, bits: int = 16) -> DataFrame:
    """Events recorded before one of a smaller id, whatever ids are missing.

    Ids are cut into blocks of 2^bits: within one, a running maximum; between blocks, the maximum of all before, over a table
    that has one row for each block.
    """
    events = log.select("event_id", "recorded_at_ns", F.shiftright("event_id", bits).alias("__block"))
    blocks = events.groupBy("__block").agg(F.max("recorded_at_ns").alias("most"))
    before = F.max("most").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("__block", before.alias("__before"))
    inside = F.max("recorded_at_ns").over(Window.partitionBy("__block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    held = events.withColumn("__inside", inside).join(blocks, "__block")
    return held.where("recorded_at_ns < greatest(__inside, __before)").select("event_id")


def violations(nodes: DataFrame, edges: DataFrame, log: DataFrame, check_fold: bool = True) -> DataFrame:
    """All violations; none for a sound graph. The last check compares the stored edges with the fold of the log."""

    def repeated(df: DataFrame, key: str, of: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"), F.min(of).alias(of)).where("n > 1")

    confidence = F.col("confidence")
    found = [
        _found(repeated(nodes, "node_id", "node_id"), "node_id_repeated", "node_id", "several nodes have this id"),
        _found(repeated(nodes, "ext_id", "node_id"), "ext_id_repeated", "node_id", "several nodes have this one's ext_id"),
        _found(nodes.where("ext_id is null or ext_id = ''"), "ext_id_empty", "node_id", "node without ext_id"),
        _found(repeated(edges, "edge_id", "edge_id"), "edge_id_repeated", "edge_id", "several edges have this id"),
        dangling(edges, nodes),
        _found(edges.where("valid_to_ns < valid_from_ns"), "inverted", "edge_id", "valid_to before valid_from"),
        _found(edges.where(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1)), "confidence", "edge_id", "confidence out of range"),
        _found(repeated(log, "event_id", "event_id"), "event_id_repeated", "event_id", "several events have this id"),
    ]
    found.append(_found(out_of_order(log), "event_order", "event_id", "recorded before an event before it"))
    if check_fold:
        names = [f.name for f in EDGES if f.name != "props"]
        a, b = edges.select(*names), fold_edges(log).select(*names)
        odd = a.exceptAll(b).union(b.exceptAll(a)).select("edge_id").distinct()
        found.append(_found(odd, "fold", "edge_id", "edge differs from the fold of the log"))
    return reduce(DataFrame.union, found)
