"""Benchmark decontamination: each shard of the corpus gets an FM-index, in which the phrases of all items are searched.

A shard is a bounded slice of a partition's documents. Its sequence has a symbol for each word of a phrase; only runs of
words in which each two neighbours are neighbours in some phrase can hold one, so the others are left out of the index
beforehand. Phrases are searched backwards all at once, their occurrences located from sampled positions, and the spans of
one document merged. Items are taken in blocks of bounded size, one pass over the corpus each, of which only documents with
hits are kept. A null text or item has no words; an item without words has no phrase; items of equal text or id are told
apart by their ids, equal ids count once, and a null id counts as the empty string. Rows with equal doc_id and text have equal
results. Further columns are not looked at, whatever their names; where documents are returned, they go along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, alnum_words, arrow_schema, join_checked, map_rows, materialize, packed, pieces, texts, unpacked
from .fmindex import FMIndex


class Phrases:
    """Windows of item words as rows of word numbers, by length, with the items each belongs to."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add("" if item is None else str(item))
        self.top = len(self.numbers)
        self.by_length: dict[int, tuple[np.ndarray, list[frozenset[str]]]] = {}
        for n in sorted({len(p) for p in found}):
            mine = sorted(p for p in found if len(p) == n)
            self.by_length[n] = np.array(mine, dtype=np.int64), [frozenset(found[p]) for p in mine]
        self.shortest = min(self.by_length, default=0)
        pairs = {a * (self.top + 1) + b for p in found for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.slots = np.zeros(1 << max(10, (16 * len(pairs)).bit_length()), dtype=bool)
        self.slots[self._slot(self.pairs)] = True
        self.alone = np.zeros(self.top + 1, dtype=bool)
        if 1 in self.by_length:
            self.alone[self.by_length[1][0][:, 0]] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def runs(self, text: np.ndarray) -> np.ndarray:
        """Which words stand in a run that is long enough, each two neighbours of which are neighbours in some phrase."""
        keep = self.alone[text]
        if len(text) < 2:
            return keep
        pair = text[:-1] * (self.top + 1) + text[1:]
        linked = (text[:-1] > 0) & (text[1:] > 0)
        linked[linked] = self.slots[self._slot(pair[linked])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        least = min((n for n in self.by_length if n > 1), default=0)
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if least and b - a + 1 >= least:
                keep[a : b + 1] = True
        return keep


def shard_hits(docs: list[bytes], phrases: Phrases, sample: int = 8) -> tuple[list[int], list[list[int]], list[set[str]]]:
    """For each document of a shard: its number of words, merged spans [start, end, start, end, ...] and items."""
    counts, parts, base = [], [], 0
    get = phrases.numbers.get
    for text in docs:
        words = alnum_words(text)
        counts.append(len(words))
        parts += [np.array(list(map(get, words, repeat(0))), dtype=np.int64), np.zeros(1, dtype=np.int64)]
    spans: list[list[int]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    text = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    keep = phrases.runs(text) if len(text) and phrases.by_length else np.zeros(len(text), dtype=bool)
    if not keep.any():
        return counts, spans, items
    places = np.flatnonzero(keep)
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    sequence = np.concatenate((np.insert(text[places], breaks, 0), [0]))
    where = np.concatenate((np.insert(places, breaks, -1), [-1]))
    index = FMIndex(sequence, phrases.top, sample)
    firsts = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
    found: list[tuple[np.ndarray, int]] = []
    for n, (rows, owners) in phrases.by_length.items():
        low, high = index.search(rows)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        times = high[hit] - low[hit]
        which = np.repeat(hit, times)
        suffixes = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
        at = where[index.locate(suffixes)]
        found.append((at, n))
        doc = np.searchsorted(firsts, at, side="right") - 1
        for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d] |= owners[p]
    covered = np.zeros(len(text) + 1, dtype=np.int64)
    for at, n in found:
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
    inside = np.cumsum(covered) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        d = int(np.searchsorted(firsts, a, side="right")) - 1
        spans[d] += [a - int(firsts[d]), b - int(firsts[d])]
    return counts, spans, items


def item_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of at most so many bytes, or one item, so that what tasks are sent is bounded."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where(F.length("text") > 0).toLocalIterator():
        text = (r.text or "").encode()
        if block and held + len(text) > most_bytes:
            yield block
            block, held = [], 0
        block.append((r.item_id, text))
        held += len(text)
    yield block


HITS = "doc_id long, key long, n_words long, spans array<long>, items array<string>"


def block_spans(docs: DataFrame, block: list[tuple[object, bytes]], window: int = 10, only_hits: bool = False) -> DataFrame:
    """HITS of every row of docs, or of those with hits, for a block of items: spans in words of the whole text, end exclusive.

    key is a hash of doc_id and text.
    """
    schema = arrow_schema(HITS)
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(held.value, window)
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                counts, spans, items = shard_hits(texts(piece, "text"), phrases)
                arrays = [piece.column(0), piece.column(1), *(pa.array(v, type=f.type) for v, f in zip((counts, spans, [sorted(x) for x in items]), list(schema)[2:], strict=True))]
                out = pa.RecordBatch.from_arrays(arrays, schema=schema)
                yield out.filter(pa.array([bool(x) for x in spans], type=pa.bool_())) if only_hits else out

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, HITS)


def block_filter(docs: DataFrame, block: list[tuple[object, bytes]], window: int = 10) -> DataFrame:
    """The rows of docs in which no phrase of a block of items occurs."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(held.value, window)
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                yield piece.filter(pa.array([not s for s in shard_hits(texts(piece, "text"), phrases)[1]], type=pa.bool_()))

    return map_rows(docs, run)


def _covered(spans: list[int]) -> int:
    """Words in the union of spans, given in pairs."""
    total, done = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total, done = total + max(0, b - max(a, done)), max(done, b)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of docs.

    With one block of items that is a single pass without a shuffle. With more, each block gives the rows it hits; those of one
    document are gathered and join the narrow rows of all documents.
    """
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    spec = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema = arrow_schema(spec)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.to_pydict()
            hits = [_covered(s or []) for s in held["spans"]]
            items = [sorted(set(i or ())) for i in held["items"]]
            sums = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_pydict({"doc_id": held["doc_id"], "n_words": held["n_words"], "n_hit": hits, "n_items": [len(i) for i in items], "items_sha256": sums, "contaminated": [h > 0 for h in hits]}, schema=schema)

    every = block_spans(docs, first, window)
    if second is not None:
        every = materialize(every, "spans")
        hits = every.where(F.size("spans") > 0).select("key", "spans", "items").dropDuplicates(["key"])
        for block in chain((second,), blocks):  # one block at a time is held and sent
            more = materialize(block_spans(docs, block, window, True), "spans")
            hits = hits.union(more.select("key", "spans", "items").dropDuplicates(["key"]))
        hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        every = join_checked(every.select("doc_id", "key", "n_words"), materialize(hits, "hits"), ["key"], "left", salt_by=F.monotonically_increasing_id())
    return every.select("doc_id", "key", "n_words", "spans", "items").mapInArrow(digest, spec)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows in which an item's phrase occurs; columns as they were.

    With one block of items that is a single pass. With more, each gives the keys of the rows it hits, and rows go by their keys.
    """
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return block_filter(docs, first, window)
    keys = None
    for block in chain((first, second), blocks):
        part = materialize(block_spans(docs, block, window, True).select("key").distinct(), "keys")
        keys = part if keys is None else keys.union(part)
    rows = packed(docs, F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("deal"))
    held = join_checked(rows, materialize(keys.distinct().withColumn("hit", F.lit(True)), "keys"), ["key"], "left", salt_by=F.col("deal"))
    return unpacked(held.where("hit is null"), docs)
