"""Bulk writes: edges from a DataFrame get nodes, ids and events in input order without passing through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StorageError
from ..functions.timeutil import now_ns
from ..schema import EDGES, EVENTS, NODES, PROPS
from .store import Store, Version

PARTITION_BITS = 33


def numbered(store: Store, df: DataFrame, name: str, folder: str, first: int = 0, order: str | None = None) -> DataFrame:
    """df with a dense number from ``first`` on, in its own order or that of a column; only counts by partition meet. What it
    writes goes to ``folder`` of the store's scratch space."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    scratch = f"{store.files.root}/data/.scratch/{folder}/{name}"
    df.withColumn("__m", F.monotonically_increasing_id()).write.parquet(scratch)
    held = store.spark.read.parquet(scratch).withColumn("__p", F.shiftright("__m", PARTITION_BITS))
    counts = held.groupBy("__p").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("__o", F.sum("n").over(Window.orderBy("__p")) - F.col("n")).select("__p", "__o")
    place = F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1)) + first
    return held.join(F.broadcast(offsets), "__p").withColumn(name, place).drop("__m", "__p", "__o")


def problem() -> Column:
    """Why a row of EDGE_INPUT columns cannot be an edge; null if it can."""
    confidence = F.col("confidence")
    return (
        F.when(F.coalesce("from", F.lit("")) == "", "from is empty")
        .when(F.coalesce("to", F.lit("")) == "", "to is empty")
        .when(F.coalesce("edge_type", F.lit("")) == "", "edge_type is empty")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1), F.concat(F.lit("confidence out of range: "), F.coalesce(confidence.cast("string"), F.lit("null"))))
        .when(F.col("valid_from_ns").isNull(), "valid_from is missing")
        .when(F.col("valid_to_ns") < F.col("valid_from_ns"), "valid_to before valid_from")
    )


def bulk_add_edges(store: Store, rows: DataFrame, base: Version | None = None, parity: bool = False, clock=now_ns, streams: dict[str, int] | None = None) -> Version:
    """Commit rows of EDGE_INPUT columns as edges; rows with a problem() are left out, see there.

    With parity, the ends of rows that have all names but are no valid edges otherwise become nodes all the same, and use up an edge id.
    """
    folder = uuid.uuid4().hex
    try:
        return _add_edges(store, rows, store.version() if base is None else base, parity, clock, streams, folder)
    finally:  # its own only: other writers have theirs
        store.files.remove(f"data/.scratch/{folder}")


def _add_edges(store: Store, rows: DataFrame, base: Version, parity: bool, clock, streams: dict[str, int] | None, folder: str) -> Version:
    at = max(base.recorded_at_ns, clock())
    if "props" not in rows.columns:
        rows = rows.withColumn("props", F.create_map().cast(PROPS))
    reason = problem()
    rows = rows.withColumn("__bad", reason)
    named = (F.coalesce("from", F.lit("")) != "") & (F.coalesce("to", F.lit("")) != "") & (F.coalesce("edge_type", F.lit("")) != "")
    placed = numbered(store, rows.where(F.col("__bad").isNull() | (named if parity else F.lit(False))), "ord", folder)
    ends = placed.select(F.col("from").alias("ext_id"), (F.col("ord") * 3).alias("pos")).union(placed.select(F.col("to").alias("ext_id"), (F.col("ord") * 3 + 1).alias("pos")))
    known = store.read("nodes", base).select("ext_id", "node_id")
    new = ends.groupBy("ext_id").agg(F.min("pos").alias("pos")).join(known.select("ext_id"), "ext_id", "left_anti")
    new = numbered(store, new, "node_id", folder, base.last["node"] + 1, "pos")
    nodes = new.select("node_id", "ext_id", F.lit(None).cast("string").alias("node_type"), F.lit(at).alias("created_at_ns"), F.create_map().cast(PROPS).alias("props"), "pos")
    ids = known.union(nodes.select("ext_id", "node_id"))
    good = placed.where("__bad is null")
    edges = good.join(ids.select(F.col("ext_id").alias("from"), F.col("node_id").alias("from_id")), "from").join(ids.select(F.col("ext_id").alias("to"), F.col("node_id").alias("to_id")), "to")
    edges = edges.select(
        (F.col("ord") + base.last["edge"] + 1).alias("edge_id"), "from_id", F.col("from").alias("from_ext_id"), "to_id", F.col("to").alias("to_ext_id"), "edge_type", "valid_from_ns", "valid_to_ns",
        F.coalesce("observed_at_ns", "valid_from_ns").alias("observed_at_ns"), F.coalesce("source", F.lit("")).alias("source"), F.col("confidence").cast("float").alias("confidence"), F.lit(None).cast("long").alias("supersedes"), F.coalesce("props", F.create_map().cast(PROPS)).alias("props"),
    )
    staged = {"nodes": store.stage("nodes", nodes), "edges": store.stage("edges", edges)}
    nodes_at, edges_at = (store.spark.read.schema(s).parquet(f"{store.files.root}/data/{t}/{staged[t]}") for t, s in (("nodes", NODES), ("edges", EDGES)))
    none = F.lit(None)
    added = nodes_at.join(new.select("node_id", "pos"), "node_id").select("pos", F.lit(1).alias("kind"), F.struct(*NODES.names).alias("node"), none.cast(EDGES).alias("edge"))
    seen = edges_at.select(((F.col("edge_id") - base.last["edge"] - 1) * 3 + 2).alias("pos"), F.lit(3).alias("kind"), none.cast(NODES).alias("node"), F.struct(*EDGES.names).alias("edge"))
    log = numbered(store, added.union(seen), "event_id", folder, base.last["event"] + 1, "pos")
    log = log.select("event_id", F.lit(at).alias("recorded_at_ns"), "kind", "node", "edge", *(none.cast("long").alias(c) for c in EVENTS.names[5:]))
    staged["log"] = store.stage("log", log)
    n_nodes, n_edges, n_ids = nodes_at.count(), edges_at.count(), placed.count()
    if store.latest() != base.number:
        raise StorageError(f"another writer has committed version {base.number + 1}")
    last = {"node": base.last["node"] + n_nodes, "edge": base.last["edge"] + n_ids, "event": base.last["event"] + n_nodes + n_edges}
    return store.publish(base, staged, {"nodes": n_nodes, "edges": n_edges, "log": n_nodes + n_edges}, last, at, streams)
