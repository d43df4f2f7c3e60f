"""What the event log recorded in a range of write times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_KINDS

COUNTERS = {"nodes_added": 1, "nodes_removed": 2, "edges_added": 3, "edges_invalidated": 4, "edges_superseded": 5, "properties_updated": 6}


def events_between(log: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Events of known kinds recorded from start to end, both included; none if the end is before the start."""
    return log.where(F.col("recorded_at_ns").between(start_ns, end_ns) & F.col("kind").isin(*EVENT_KINDS))


def kind_name() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in EVENT_KINDS.items() for x in pair)), F.col("kind"))


def diff_entries(log: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """``kind, at_ns, event_id`` with the node or edge concerned, in order of write time and id."""
    found = events_between(log, start_ns, end_ns)
    node = F.when(F.col("kind") == 1, F.col("node.node_id")).when(F.col("kind") == 2, F.col("target_node_id"))
    edge = F.when(F.col("kind").isin(3, 5), F.col("edge.edge_id")).when(F.col("kind") == 4, F.col("target_edge_id"))
    return found.select(kind_name().alias("kind"), F.col("recorded_at_ns").alias("at_ns"), "event_id", node.alias("node_id"), edge.alias("edge_id")).orderBy("at_ns", "event_id")


def diff_summary(log: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """One row of the six counters, summed before the only, single-row exchange."""
    return events_between(log, start_ns, end_ns).agg(*(F.count_if(F.col("kind") == k).alias(name) for name, k in COUNTERS.items()))
