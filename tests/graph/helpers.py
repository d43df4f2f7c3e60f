"""Graphs by short notation, and a plain FIFO search to compare with."""

from collections import deque

from weftline.schema import EDGES


def edges(spark, rows):
    """rows: (id, from, to, valid_from_ns, valid_to_ns) with optional type, source, confidence, supersedes."""
    full = []
    for r in rows:
        i, a, b, start, end, kind, source, confidence, old = (*r, *("E", "s", 1.0, None)[len(r) - 5 :])
        full.append((i, abs(hash(a)) % 1000, a, abs(hash(b)) % 1000, b, kind, start, end, start, source, confidence, old, {}))
    return spark.createDataFrame(full, EDGES)


def plain_search(rows, start, hops, at):
    """Edge ids in the order a queue emits them, and the path to each node reached."""
    live = sorted((r for r in rows if r[3] <= at and (r[4] is None or at < r[4])), key=lambda r: (r[3], r[0]))
    out, paths, queue = [], {start: []}, deque([(start, 0)])
    while queue:
        node, depth = queue.popleft()
        if depth >= hops:
            continue
        for r in live:
            if r[1] == node:
                out.append(r[0])
                if r[2] not in paths:
                    paths[r[2]] = [*paths[node], r[0]]
                    queue.append((r[2], depth + 1))
    return out, paths
