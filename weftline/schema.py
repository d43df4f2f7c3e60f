"""Columns of the graph tables. Times are nanoseconds since 1970 UTC in BIGINT columns; an open end is null."""

from __future__ import annotations

from pyspark.sql import types as T

#: A property value: kind (null, bool, int, float, string, bytes) and its text; bytes in base64.
PROP = T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])
PROPS = T.MapType(T.StringType(), PROP)

NODES = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("ext_id", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("created_at_ns", T.LongType()),
        T.StructField("props", PROPS),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_id", T.LongType()),
        T.StructField("from_id", T.LongType()),
        T.StructField("from_ext_id", T.StringType()),
        T.StructField("to_id", T.LongType()),
        T.StructField("to_ext_id", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("valid_from_ns", T.LongType()),
        T.StructField("valid_to_ns", T.LongType()),
        T.StructField("observed_at_ns", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("supersedes", T.LongType()),
        T.StructField("props", PROPS),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("recorded_at_ns", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("node", NODES),
        T.StructField("edge", EDGES),
        T.StructField("target_edge_id", T.LongType()),
        T.StructField("target_node_id", T.LongType()),
        T.StructField("at_ns", T.LongType()),
    ]
)
#: What an import or a bulk write takes: one row per edge, times already parsed.
EDGE_INPUT = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("valid_from_ns", T.LongType()),
        T.StructField("valid_to_ns", T.LongType()),
        T.StructField("observed_at_ns", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("props", PROPS),
    ]
)

EVENT_KINDS = {1: "node_added", 2: "node_removed", 3: "edge_added", 4: "edge_invalidated", 5: "edge_superseded", 6: "property_set"}
#: As the event dump names them.
EVENT_NAMES = {1: "NodeAdded", 2: "NodeRemoved", 3: "EdgeObserved", 4: "EdgeInvalidated", 5: "EdgeSuperseded", 6: "PropertySet"}
