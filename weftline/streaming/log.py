"""The event log as a stream: counters by window, late events within a watermark, and continuous imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import COUNTERS
from ..schema import EDGE_INPUT, EVENTS
from ..sources.bulk import bulk_add_edges
from ..sources.store import Store


def read_log(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """The log of a store as it grows. Folders of commits that failed are in it too: for monitoring, not for state."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/data/log")


def windowed_diff(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The counters of diff_summary() for each window of write time; repeated events count once within the watermark."""
    stamped = log.withColumn("recorded_at", F.timestamp_micros(F.floor(F.col("recorded_at_ns") / 1000).cast("long"))).withWatermark("recorded_at", late)
    once = stamped.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("recorded_at", window).alias("window")).agg(*(F.count_if(F.col("kind") == k).alias(name) for name, k in COUNTERS.items()))


def ingest(store: Store, edges: DataFrame, checkpoint: str, **trigger):
    """Commit a stream of EDGE_INPUT rows, a version for each micro-batch. The version names the stream and the batch's number, so
    a batch that is run again after a failure is not committed twice."""

    def commit(batch: DataFrame, number: int) -> None:
        base = store.version()
        if base.streams.get(checkpoint, -1) < number:
            bulk_add_edges(store, batch.select(*EDGE_INPUT.names), base, streams={checkpoint: number})

    return edges.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
