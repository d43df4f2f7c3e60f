"""Graphs from plain tables: orders and line items as a temporal graph, events as a log; generators for benchmarks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import timestamp_ns
from ..schema import EDGES, EVENTS, NODES, PROPS
from .scratch import exists, scratch_folder

#: 1999-01-01, within the span of the orders.
T_NS = 915_148_800 * 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edges(rows: DataFrame, edge_id: Column, edge_type: str, from_: tuple[str, str], to: tuple[str, str], start: Column, end: Column | None = None, source: Column | None = None) -> DataFrame:
    """Ends are numbered by their keys; confidence is a function of the id."""
    held = rows.select(
        edge_id.alias("edge_id"), F.col(from_[1]).cast("long").alias("from_id"), _name(*from_).alias("from_ext_id"), F.col(to[1]).cast("long").alias("to_id"), _name(*to).alias("to_ext_id"), F.lit(edge_type).alias("edge_type"),
        start.cast("long").alias("valid_from_ns"), (F.lit(None) if end is None else end).cast("long").alias("valid_to_ns"), start.cast("long").alias("observed_at_ns"), (F.lit("lineitem") if source is None else source).alias("source"),
    )
    return held.select("*", (F.pmod("edge_id", F.lit(101)) / 100).cast("float").alias("confidence"), F.lit(None).cast("long").alias("supersedes"), F.create_map().cast(PROPS).alias("props")).select(*EDGES.names)


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED, CONTAINS, SUPPLIED_BY and LOCATED_IN edges of EDGES columns."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", timestamp_ns(F.col("l_shipdate")).alias("ship"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lower("o_orderpriority").alias("priority"), timestamp_ns(F.col("o_orderdate")).alias("placed"))
    shipped = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("ship").alias("last"))
    placed = orders.join(shipped, "o_orderkey")
    contains = items.groupBy("l_orderkey", "l_partkey").agg(F.min("ship").alias("start"))
    supplied = items.groupBy("l_partkey", "l_suppkey").agg(F.min("ship").alias("start"))
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    million = F.lit(1_000_000).cast("long")
    done = F.when(F.col("o_orderstatus") == "F", F.greatest("placed", "last"))
    return (
        _edges(placed, F.col("o_orderkey") + 10**12, "PLACED", ("customer", "o_custkey"), ("order", "o_orderkey"), F.col("placed"), done, F.col("priority"))
        .union(_edges(contains, F.col("l_orderkey") * million + F.col("l_partkey") + 2 * 10**12, "CONTAINS", ("order", "l_orderkey"), ("part", "l_partkey"), F.col("start")))
        .union(_edges(supplied, F.col("l_partkey") * million + F.col("l_suppkey") + 3 * 10**15, "SUPPLIED_BY", ("part", "l_partkey"), ("supplier", "l_suppkey"), F.col("start")))
        .union(_edges(suppliers, F.col("s_suppkey") + 4 * 10**15, "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), F.lit(0)))
    )


_stored: dict[tuple, str] = {}


def stored_order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_graph() loaded once into a Parquet copy that is clustered by the node edges leave, as a store's edges are.

    The copy is in the shared folder and belongs to this session and to these input files, by size and time; scans of it prune
    by node and instant, which the derived columns of the plain tables cannot.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    held = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path)))
    folder = scratch_folder(spark)
    key = (folder, held)
    if key not in _stored or not exists(spark, _stored[key]):
        at = f"{folder}/graph-{uuid.uuid4().hex}"
        order_graph(spark, sf_dir).repartitionByRange("from_ext_id").sortWithinPartitions("from_ext_id", "valid_from_ns").write.parquet(at)
        _stored[key] = at
    return spark.read.schema(EDGES).parquet(_stored[key])


def order_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in order of time: an edge from each to the next, and from every third one also to the one after that."""
    row = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", timestamp_ns(F.col("o_orderdate")).alias("placed"), F.row_number().over(row).alias("i"), F.lead("o_orderkey", 1).over(row).alias("next"), F.lead("o_orderkey", 2).over(row).alias("after"))
    steps = _edges(orders.where("next is not null"), F.col("o_orderkey") + 5 * 10**15, "NEXT", ("order", "o_orderkey"), ("order", "next"), F.col("placed"))
    leaps = _edges(orders.where("after is not null and i % 3 = 1"), F.col("o_orderkey") + 6 * 10**15, "LEAP", ("order", "o_orderkey"), ("order", "after"), F.col("placed"))
    return steps.union(leaps)


def sequence_ends(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first and the last order of the customer with most orders, the least key first."""
    at = F.struct("o_orderdate", "o_orderkey")
    best = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).orderBy(F.desc("n"), "o_custkey").first()
    return f"order:{best.a.o_orderkey}", f"order:{best.b.o_orderkey}"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of EVENTS columns from events, a kind for each type; targets are the users."""
    kinds = {"signup": 1, "purchase": 3, "error": 4, "click": 5, "view": 6}
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("event_type"))
    none = F.lit(None)
    return _table(spark, sf_dir, "events").select(
        "event_id", timestamp_ns(F.col("ts")).alias("recorded_at_ns"), kind.alias("kind"), none.cast(NODES).alias("node"), none.cast(EDGES).alias("edge"), F.col("user_id").alias("target_edge_id"), F.col("user_id").alias("target_node_id"), timestamp_ns(F.col("ts")).alias("at_ns")
    ).select(*EVENTS.names)


def purchase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a user's first purchase is an edge, numbered by the user, and each later error an invalidation."""
    held = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", timestamp_ns(F.col("ts")).alias("at"))
    first = held.where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", "at").alias("event_id"), F.min("at").alias("at"))
    edge = _edges(first, F.col("user_id"), "BOUGHT", ("user", "user_id"), ("event", "event_id"), F.col("at"))
    none = F.lit(None)
    seen = edge.select(F.col("to_id").alias("event_id"), F.col("valid_from_ns").alias("recorded_at_ns"), F.lit(3).alias("kind"), none.cast(NODES).alias("node"), F.struct(*EDGES.names).alias("edge"), *(none.cast("long").alias(c) for c in EVENTS.names[5:]))
    later = held.where("event_type = 'error'").join(first.select("user_id", F.col("at").alias("start")), "user_id").where("at >= start")
    cut = later.select("event_id", F.col("at").alias("recorded_at_ns"), F.lit(4).alias("kind"), none.cast(NODES).alias("node"), none.cast(EDGES).alias("edge"), F.col("user_id").alias("target_edge_id"), none.cast("long").alias("target_node_id"), F.col("at").alias("at_ns"))
    return seen.union(cut)


def purchase_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as edges, each of which replaces the same user's one before."""
    held = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", timestamp_ns(F.col("ts")).alias("at"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("at"))
    rows = _edges(held, F.col("event_id"), "BOUGHT", ("user", "user_id"), ("event", "event_id"), F.col("at"))
    return rows.drop("supersedes").join(held.select(F.col("event_id").alias("edge_id"), before.alias("supersedes")), "edge_id").select(*EDGES.names)


def ring(spark: SparkSession, nodes: int, each: int = 1, versions: int = 1, step_ns: int = 1_000_000) -> DataFrame:
    """n{i} to n{(i+j+1) % nodes} for j < each; with versions, version w of an edge lives in second w."""
    rows = spark.range(nodes * each * versions)
    i, rest = F.floor(F.col("id") / (each * versions)), F.pmod("id", F.lit(each * versions))
    j, w = F.floor(rest / versions), F.pmod(rest, F.lit(versions))
    start = w * 1_000_000_000 if versions > 1 else i * step_ns
    return rows.select(
        F.concat(F.lit("n"), i.cast("string")).alias("from"), F.concat(F.lit("n"), F.pmod(i + j + 1, F.lit(nodes)).cast("string")).alias("to"), F.lit("E").alias("edge_type"), start.cast("long").alias("valid_from_ns"),
        (start + 1_000_000_000 if versions > 1 else F.lit(None)).cast("long").alias("valid_to_ns"), start.cast("long").alias("observed_at_ns"), F.lit("bench").alias("source"), F.lit(1.0).cast("float").alias("confidence"),
    )
