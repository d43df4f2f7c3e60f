"""Scratch tables of the graph operators, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Of this application, below spark.checkpoint.dir; where that is unset a temporary folder, for a local master only."""
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="weftline-")
        folder = _local[app]
    return f"{folder.rstrip('/')}/weftline/{app}"


def written(df: DataFrame, label: str = "level") -> DataFrame:
    """df written once and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._weftline_path = path
    return back


def _found(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _found(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _found(spark, path)
    files.delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove what written() wrote, once nothing reads it any more."""
    if path := getattr(df, "_weftline_path", None):
        remove(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application, once no result that reads them is needed any more."""
    remove(spark, scratch_folder(spark))
