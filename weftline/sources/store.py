"""A graph on disk: Parquet folders, and commit files that name them. A commit file is the only thing that publishes.

    root/_meta.json                     what this is
    root/data/<table>/<uuid>/           nodes, edges, edges_in, cuts (invalidations), log; written once, never changed
    root/commits/<version>.json         folders of all tables at that version, counters, counts

A snapshot is one version: readers never see later commits. Writers prepare folders and then create the next version's
file; whoever comes second finds it there and fails. Everything goes through Hadoop's file systems, so a root may be in
any store that Spark writes.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError, NotFoundError, StorageError
from ..schema import EDGES, EVENTS, NODES

MAGIC, VERSION = "weftline-graph", 1
META_KEYS = ("magic", "format_version", "writer_version", "required_features")
CUTS = T.StructType([T.StructField("edge_id", T.LongType()), T.StructField("at_ns", T.LongType())])
#: edges_in is a second copy of the edges that compact() wrote, by the node they enter.
TABLES = {"nodes": NODES, "edges": EDGES, "edges_in": EDGES, "cuts": CUTS, "log": EVENTS}


class Files:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        self.local = self.root[5:] if self.root.startswith("file:/") else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was created whole; False if there is one of that name."""
        hidden = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}".lstrip("/")
        stream = self.fs.create(self._path(hidden), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.local is not None:
            hidden_at = os.path.join(self.local, hidden)
            try:
                os.link(hidden_at, os.path.join(self.local, name))
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(self._path(hidden), False)
        done = not self.exists(name) and self.fs.rename(self._path(hidden), self._path(name))
        if not done:
            self.fs.delete(self._path(hidden), False)
        return done

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=lambda: {t: [] for t in TABLES})
    counts: dict[str, int] = field(default_factory=lambda: {t: 0 for t in TABLES})
    last: dict[str, int] = field(default_factory=lambda: {"node": 0, "edge": 0, "event": 0})
    recorded_at_ns: int = 0
    streams: dict[str, int] = field(default_factory=dict)  # last micro-batch of each stream that writes here


class Store:
    def __init__(self, spark: SparkSession, root: str, create: bool = True):
        self.spark, self.files = spark, Files(spark, root)
        if not self.files.exists("_meta.json"):
            if self.files.exists() and (self.files.names("") or self.files.fs.isFile(self.files._path(""))):
                raise FormatError(f"{root} is not a graph")
            if not create:
                raise NotFoundError(f"no graph at {root}")
            self.files.create("_meta.json", json.dumps({"magic": MAGIC, "format_version": VERSION, "writer_version": VERSION, "required_features": []}))
        try:
            self.meta = json.loads(self.files.read("_meta.json"))
        except ValueError:
            raise FormatError(f"{root}/_meta.json cannot be read") from None
        if self.meta.get("magic") != MAGIC:
            raise FormatError(f"{root} is not a graph")
        if self.meta.get("format_version", VERSION + 1) > VERSION or self.meta.get("required_features"):
            raise FormatError(f"{root} was written by a later version")

    def read_meta(self) -> dict:
        """The meta file as it is now."""
        try:
            found = json.loads(self.files.read("_meta.json"))
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def latest(self) -> int:
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        return int(names[-1][:-5]) if names else 0

    def version(self, number: int | None = None) -> Version:
        number = self.latest() if number is None else number
        if number == 0:
            return Version()
        if not self.files.exists(f"commits/{number:020}.json"):
            raise NotFoundError(f"version {number}")
        return Version(**json.loads(self.files.read(f"commits/{number:020}.json")))

    def read(self, table: str, version: Version) -> DataFrame:
        return self._folders([f"{table}/{f}" for f in version.folders[table]], TABLES[table])

    def _folders(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/data/{n}" for n in names))

    def edges(self, version: Version, entering: bool = False) -> DataFrame:
        """Edges with their ends: the least of the first one and of all invalidations.

        ``entering``: from the copy by the node edges enter as far as there is one, for queries that name that node.
        """
        held = [f"edges/{f}" for f in version.folders["edges"]]
        if entering and version.folders["edges_in"]:
            held[0] = f"edges_in/{version.folders['edges_in'][0]}"  # a compacted version's first folder is the copied one
        edges = self._folders(held, EDGES)
        if not version.folders["cuts"]:
            return edges
        cuts = self.read("cuts", version).groupBy("edge_id").agg(F.min("at_ns").alias("__cut"))
        return edges.join(cuts, "edge_id", "left").withColumn("valid_to_ns", F.least("valid_to_ns", "__cut")).select(*EDGES.names)

    def stage(self, table: str, rows: DataFrame) -> str:
        """Write rows to a folder that no version names yet."""
        folder = uuid.uuid4().hex
        rows.select(*TABLES[table].names).write.parquet(f"{self.files.root}/data/{table}/{folder}")
        return folder

    def publish(self, base: Version, staged: dict[str, str], added: dict[str, int], last: dict[str, int], recorded_at_ns: int, streams: dict[str, int] | None = None) -> Version:
        new = Version(base.number + 1, {t: [*base.folders[t], *([staged[t]] if t in staged else [])] for t in TABLES}, {t: base.counts[t] + added.get(t, 0) for t in TABLES}, last, recorded_at_ns, base.streams | (streams or {}))
        self._create(new)
        return new

    def _create(self, new: Version) -> None:
        self.files.fs.mkdirs(self.files._path("commits"))
        if not self.files.create(f"commits/{new.number:020}.json", json.dumps(vars(new))):
            raise StorageError(f"another writer has committed version {new.number}")

    def compact(self, files_for: dict[str, int] | None = None) -> Version:
        """A version with one folder for each table, edges with their ends set and in two copies, sorted by node so that files prune."""
        base = self.version()
        staged, clustered = {}, {"nodes": "ext_id", "edges": "from_ext_id", "edges_in": "to_ext_id", "log": "recorded_at_ns"}
        for t, key in clustered.items():
            if base.folders["edges" if t == "edges_in" else t]:
                rows = self.edges(base) if t.startswith("edges") else self.read(t, base)
                n = (files_for or {}).get(t)
                rows = rows.repartitionByRange(n, key) if n else rows.repartitionByRange(key)
                staged[t] = self.stage(t, rows.sortWithinPartitions(key))
        new = Version(base.number + 1, {t: [staged[t]] if t in staged else [] for t in TABLES}, base.counts | {"cuts": 0}, base.last, base.recorded_at_ns, base.streams)
        self._create(new)
        return new
