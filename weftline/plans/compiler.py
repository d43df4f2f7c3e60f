"""Queries to DataFrames: WHERE and LIMIT come after traversal, in the order the traversal emits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFoundError
from ..functions.predicates import conjunction
from ..functions.timeutil import now_ns, parse_ns
from ..operators import diff, temporal, traverse
from .language import Query, parse


@dataclass
class Result:
    """kind edges, path or diff. rows: edges in order, or diff entries; summary: of a diff; found: whether there is a path."""

    kind: str
    rows: DataFrame
    summary: DataFrame | None = None
    found: bool = True

    def __len__(self) -> int:
        return self.rows.count() if self.found else 0


class Compiler:
    """edges, nodes and log of one state of a graph; entering: the same edges, clustered by the node they enter. strict_for_node
    makes FOR NODE keep that node's events only."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, log: DataFrame | None = None, clock: Callable[[], int] = now_ns, strict_for_node: bool = False, entering: DataFrame | None = None):
        self.entering = edges if entering is None else entering
        self.edges, self.nodes, self.log, self.clock, self.strict = edges, nodes, log, clock, strict_for_node

    def _exists(self, node: str) -> str:
        if self.nodes is not None and not self.nodes.where(F.col("ext_id") == node).head(1):
            raise NotFoundError(f"node {node!r}")
        return node

    def _instant(self, query: Query) -> int:
        return parse_ns(query.when[1]) if query.when else self.clock()

    def _finish(self, rows: DataFrame, query: Query, *order: str) -> DataFrame:
        where = conjunction(query.where)
        rows = rows if where is None else rows.where(where)
        return temporal.in_order(rows, *order, limit=query.limit).select(*self.edges.columns)

    def run(self, query: str | Query) -> Result:
        query = parse(query) if isinstance(query, str) else query
        return getattr(self, f"_{query.shape}")(query)

    def _neighbors(self, query: Query) -> Result:
        node = self._exists(query.node)
        return Result("edges", self._finish(temporal.neighbors(self.edges, node, self._instant(query)), query))

    def _connected(self, query: Query) -> Result:
        node = self._exists(query.node)
        return Result("edges", self._finish(temporal.connected(self.edges, node, self._instant(query), self.entering), query, "direction"))

    def _hops(self, query: Query) -> Result:
        node = self._exists(query.node)
        return Result("edges", self._finish(traverse.n_hops(self.edges, node, query.hops, self._instant(query)), query, "depth", "path"))

    def _path(self, query: Query) -> Result:
        source, target = self._exists(query.node), self._exists(query.target)
        path = traverse.shortest_path(self.edges, source, target, self._instant(query))
        if path is None:
            return Result("path", self.edges.limit(0), found=False)
        return Result("path", self._finish(path, query, "step"))

    def _diff(self, query: Query) -> Result:
        start, end = map(parse_ns, query.between)
        log = self.log
        if self.strict and query.node is not None:
            edge = F.col("edge")
            near = (edge["from_ext_id"] == query.node) | (edge["to_ext_id"] == query.node) | (F.col("node.ext_id") == query.node)
            touched = self.edges.where((F.col("from_ext_id") == query.node) | (F.col("to_ext_id") == query.node)).select(F.col("edge_id").alias("target_edge_id"))
            log = log.where(near).unionByName(log.where("kind = 4").join(touched, "target_edge_id", "left_semi").select(*log.columns))
        return Result("diff", diff.diff_entries(log, start, end), diff.diff_summary(log, start, end))

    _changed = _diff
