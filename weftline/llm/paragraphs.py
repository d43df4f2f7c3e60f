"""Substring dedup by MinHash over sliding paragraphs.

Every ``window`` words of a text are a paragraph. Its MinHash over five-word shingles, two rows, is its band key; neighbours with
one key are kept as one. The window is tuned so that the band misses nothing it should find: two passages of at least the
similarity asked for that differ by changed words have as many words in one piece in common (see tuned_window()), and equal
paragraphs collide with certainty. Of the texts that collide in a key the first, by doc_id, is the pivot, and every other is
compared with it: from the places where they collide on, equal words are followed to both sides to the end of the common
piece, and pieces are joined over differing words as long as the two passages have the exact Jaccard similarity asked for over
their sets of shingles. Words themselves are compared, not their hashes. Paragraphs that a key stands for and that are in no passage shared with
its pivot are looked up once more by all their words, so what equals some other text is found whoever the pivot was.

Passages of ``least`` words or more that two documents share are reported. Of two linked ones the later document's is removed, so
that the first occurrence stays. Overlapping passages of a document are one node, links between nodes make components.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and short texts have no paragraphs. Rows with equal doc_id and text are
one document here, and all get its spans; rows without a doc_id are told apart by their texts and come last. Repeats within one
document only are no matter. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, connected_components, discard, hot_keys, join_hot, materialize, packed, pieces, texts, unpacked, white_words

SHINGLE = 5
BASE = 0x5851F42D4C957F2D
MIX = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1
#: Segments begin and end at multiples of so many words, and reach so far beyond the places where texts collide.
CELL = 64


def tuned_window(similarity: float, shingle: int = SHINGLE) -> int:
    """The most words that passages of such a similarity, if they differ by changed words, surely have in common in one piece.

    A changed word takes ``shingle`` shingles from either side, so with m of them there are at least m * shingle * (1 + s) / (1 - s)
    shingles; the other words make m + 1 pieces, and the longest is no shorter than their mean.
    """
    n = shingle * (1 + similarity) / (1 - similarity)
    return min(int((m * n + shingle - 1 - m) / (m + 1) + 1e-9) for m in range(1, 100))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 7)
        return found


class Sequence:
    """The words of some documents one after another; hashes of any of their ranges from sums."""

    def __init__(self, docs: list[bytes], memo: Words):
        hashes: list[int] = []
        self.starts = [0]
        for text in docs:
            hashes += map(memo.__getitem__, white_words(text.lower()))
            self.starts.append(len(hashes))
        self.n = len(hashes)
        self.words = np.array(hashes, dtype=np.uint64)
        power = np.full(self.n + 1, BASE, dtype=np.uint64)
        inverse = np.full(self.n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.words * power[: self.n], dtype=np.uint64)))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all k words from each place on, also across documents; none if there are fewer."""
        at = np.arange(max(0, self.n - k + 1))
        return mixed((self.sums[at + k] - self.sums[at]) * self.inverse[at] + np.uint64(k))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    held, size = values, 1
    while size * 2 <= width:
        held, size = np.minimum(held[: len(held) - size], held[size:]), size * 2
    rest = width - size
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def band_keys(seq: Sequence, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of neighbouring paragraphs with one band key, the least shingle of the first row at one place: document, key,
    that place, and whether the document had the key before."""
    empty = np.empty(0, dtype=np.int64)
    if seq.n < window:
        return empty, empty.view(np.uint64), empty, empty.astype(bool)
    width = window - SHINGLE + 1
    shingles = seq.windows(SHINGLE)
    key = mixed(sliding_least(shingles, width) ^ mixed(sliding_least(mixed(shingles * np.uint64(3)), width)))
    bounds, at = np.array(seq.starts), np.arange(len(key))
    doc = np.searchsorted(bounds, at, side="right") - 1
    inside = at + window <= bounds[doc + 1]
    first = at + np.argmin(np.lib.stride_tricks.sliding_window_view(shingles, width), axis=1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1]) | (first[1:] != first[:-1])
    low = np.flatnonzero(new & inside)
    first, doc, key = first[low], doc[low], key[low]
    order = np.lexsort((low, key, doc))
    again = np.zeros(len(low), dtype=bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return doc, key, first - bounds[doc], again


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``; row is a hash of doc_id and text."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def key_table(docs: DataFrame, window: int) -> DataFrame:
    """``key, doc_id, row, at, again`` of all documents, written to the shared folder."""
    spec = "key long, doc_id long, row long, at int, again boolean"
    schema = arrow_schema(spec)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                seq = Sequence(texts(piece, "text"), memo)
                doc, key, at, again = band_keys(seq, window)
                ids = [piece.column(i).take(pa.array(doc)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *ids, pa.array(at.astype(np.int32)), pa.array(again)], schema=schema)

    return materialize(identified(docs).mapInArrow(make, spec), "keys")


# ---------------------------------------------------------------- colliding texts


def collisions(keys: DataFrame, *more: str) -> DataFrame:
    """``doc_id, row, at, pivot``: the places of keys that several documents have, each beside the key's first place; written out.

    Keys are counted first, as a narrow table, and places of one document's own keys go no further. ``more``: columns that go along.
    """
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row", "at", *more)
    shared = materialize(keys.groupBy("key").agg(F.count_if(~F.col("again")).alias("n")).where("n > 1"), "shared")
    hot = hot_keys(shared, ["key"], "n")
    held = materialize(join_hot(keys.select("key", "doc_id", "row", "at", *more), shared.select("key"), ["key"], hot, F.col("row")), "held")
    pivots = held.groupBy("key").agg(F.min(place).alias("pivot"))
    out = materialize(join_hot(held, pivots, ["key"], hot, F.col("row")).where("row <> pivot.row").select("doc_id", "row", "at", "pivot", *more), "collisions")
    discard(shared)
    discard(held)
    return out


def _cells(low: Column, high: Column) -> list[Column]:
    low, high = F.floor((low - CELL) / CELL) * CELL, F.ceil((high + SHINGLE + CELL) / CELL) * CELL
    return [F.greatest(low, F.lit(0)).cast("int"), high.cast("int")]


def text_pairs(places: DataFrame, *more: str) -> DataFrame:
    """One row for each document and pivot that collide: ``doc_id, row, low, high, p_doc, p_row, p_low, p_high, lines``.

    lines: where they collide, as (first and last place, shift from the document to the pivot); low to high: the words to look at.
    ``more``: low and high if places have them, as do their pivots.
    """
    shift = (F.col("pivot.at") - F.col("at")).alias("shift")
    known = [*more, *(F.col(f"pivot.{c}").alias(f"p_{c}") for c in more)]
    on = ["doc_id", "row", "p_doc", "p_row", *more, *(f"p_{c}" for c in more)]
    lines = places.groupBy("doc_id", "row", F.col("pivot.doc").alias("p_doc"), F.col("pivot.row").alias("p_row"), *known, shift)
    lines = lines.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    moved = F.col("first") + F.col("shift"), F.col("last") + F.col("shift")
    out = lines.groupBy(*on).agg(
        F.min("first").alias("a"), F.max("last").alias("b"), F.min(moved[0]).alias("c"), F.max(moved[1]).alias("d"), F.sort_array(F.collect_list(F.struct("first", "last", "shift"))).alias("lines")
    )
    if not more:
        for name, column in zip(("low", "high", "p_low", "p_high"), (*_cells(F.col("a"), F.col("b")), *_cells(F.col("c"), F.col("d"))), strict=True):
            out = out.withColumn(name, column)
    return materialize(out.select("doc_id", "row", "low", "high", "p_doc", "p_row", "p_low", "p_high", "lines"), "pairs")


def segments(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row, low, high, words``: the words of all segments that pairs name, each once; written out. One pass over the texts."""
    spec = "row long, low int, high int, words binary"
    schema = arrow_schema(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                for row, text, ranges in zip(piece.column(0).to_pylist(), texts(piece, "text"), piece.column(2).to_pylist(), strict=True):
                    if row == before:  # repeated rows follow each other after the merge join
                        continue
                    before = row
                    words = white_words(text.lower())
                    out = [(row, r["low"], r["high"], b" ".join(words[r["low"] : r["high"]])) for r in ranges]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    both = pairs.select("row", "low", "high").union(pairs.select(F.col("p_row").alias("row"), F.col("p_low").alias("low"), F.col("p_high").alias("high")))
    wanted = both.distinct().groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    held = identified(docs)
    held = held.select("row", "text").hint("merge").join(wanted, "row").select("row", "text", "ranges")  # one plan at every size
    return materialize(held.mapInArrow(cut, spec), "segments")


# ---------------------------------------------------------------- verification


def shingle_codes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each shingle of two sequences of word numbers, from 0 on without gaps, the same for the same words."""
    both = np.concatenate((x, [-1] * SHINGLE, y)).astype(np.int64) + 1
    top = int(both.max()) + 1
    code = both
    for j in range(1, SHINGLE):
        if int(code.max()) >= (1 << 62) // top:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code[:-1] * top + both[j:]
    code = np.unique(code, return_inverse=True)[1]
    return code[: max(0, len(x) - SHINGLE + 1)], code[len(x) + SHINGLE :]


def equal_pieces(x: np.ndarray, y: np.ndarray, lines: list[tuple[int, int, int]], start: int) -> list[tuple[int, int, int]]:
    """Pieces of at least a shingle of equal words near lines (first, last, shift): (begin, end, shift), to their full length.

    A line is passed over if all words up to ``start`` beside it are in pieces already.
    """
    found: set[tuple[int, int, int]] = set()
    seen = np.zeros(len(x), dtype=bool)
    for first, last, shift in lines:
        low, high = max(0, -shift), min(len(x), len(y) - shift)
        if high - low < SHINGLE or seen[max(0, first - start) : last + SHINGLE + start].all():
            continue
        a, b, reach = max(low, first - CELL), min(high, last + SHINGLE + CELL), CELL
        while True:  # as long as equal words go on beyond what was looked at
            same = x[a:b] == y[a + shift : b + shift]
            left, right = a > low and same[0], b < high and same[-1]
            if not left and not right:
                break
            reach *= 2
            a, b = max(low, a - reach * left), min(high, b + reach * right)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i >= SHINGLE:
                found.add((a + i, a + j, shift))
                seen[a + i : a + j] = True
    return sorted(found)


def common_passages(x: np.ndarray, y: np.ndarray, lines: list[tuple[int, int, int]], similarity: float, least: int, start: int) -> list[tuple[int, int, int, int]]:
    """Passages of two sequences of word numbers, as (begin, end, begin, end), that are alike: from the longest equal piece on, of
    ``start`` words or more, the next ones to the left and right are taken in while the exact Jaccard similarity of the whole stays high enough."""
    left = equal_pieces(x, y, lines, 2 * start)
    if not left:
        return []
    u, v = shingle_codes(x, y)
    if any(p > 0 and s + p > 0 or q < len(x) and q + s < len(y) for p, q, s in left):  # shorter pieces beside, moved by words left out
        near = np.zeros(len(u), dtype=bool)
        for p, q, _ in left:
            near[max(0, p - (q - p) - SHINGLE) : q + (q - p) + SHINGLE] = True
        for p, q, _ in left:
            near[p : q - SHINGLE + 1] = False
        at = np.flatnonzero(near)
        where = np.full(int(max(u.max(), v.max())) + 1, -1)
        where[v[::-1]] = np.arange(len(v))[::-1]
        to = where[u[at]]
        more = [(i, i, j - i) for i, j in zip(at[to >= 0].tolist(), to[to >= 0].tolist(), strict=True)]
        left = sorted({*left, *equal_pieces(x, y, more, 0)}) if more else left
    out = []
    ul, vl = u.tolist(), v.tolist()
    for a, b, shift in sorted(left, key=lambda p: (p[0] - p[1], p)):
        if b - a < start:
            break
        if any(p <= a and b <= q for p, q, _, _ in out):
            continue
        c, d = a + shift, b + shift
        mine = set(ul[a : b - SHINGLE + 1])  # the sets of shingles so far, and how many both have
        other, both = set(mine), len(mine)

        def taken(low: int, high: int, p_low: int, p_high: int) -> bool:
            """Take in these further shingles of either side if the passages stay alike."""
            nonlocal both
            more, p_more = set(ul[low:high]) - mine, set(vl[p_low:p_high]) - other
            common = both + len(more & other) + len(p_more & mine) + len(more & p_more)
            if common < similarity * (len(mine) + len(more) + len(other) + len(p_more) - common):
                return False
            mine.update(more)
            other.update(p_more)
            both = common
            return True

        before, after = [p for p in left if p[0] < a][::-1], [p for p in left if p[1] > b]
        grown = bool(before or after)
        while grown:
            grown = False
            for i, (p, q, s) in enumerate(before):
                if a - q > b - a:
                    break
                if p < a and p + s < c and taken(p, a, p + s, c):
                    a, c, before, grown = p, p + s, before[i + 1 :], True
                    break
            for i, (p, q, s) in enumerate(after):
                if p - b > b - a:
                    break
                if q > b and q + s > d and taken(b - SHINGLE + 1, q - SHINGLE + 1, d - SHINGLE + 1, q + s - SHINGLE + 1):
                    b, d, after, grown = q, q + s, after[i + 1 :], True
                    break
        out.append((a, b, c, d))
        left = [p for p in left if p[0] < a or p[1] > b]
    return [p for p in out if max(p[1] - p[0], p[3] - p[2]) >= least]


def numbered_words(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words of two segments as numbers, the same for the same words."""
    x, y = white_words(a), white_words(b)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    return tuple(np.fromiter(map(numbers.__getitem__, w), dtype=np.int64, count=len(w)) for w in (x, y))


MATCH = "doc_id long, row long, first int, last int, p_doc long, p_row long, p_first int, p_last int, keys array<long>, at array<int>"


def open_paragraphs(words: bytes, n: int, lines: list[tuple[int, int, int]], found: list[tuple[int, int, int, int]], window: int, memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the paragraphs, of a segment of n words, that a colliding key stands for and that are not in a passage found."""
    maybe, collides = np.zeros(max(0, n - window + 1), dtype=bool), np.zeros(n, dtype=bool)
    for a, b, _ in lines:
        maybe[max(0, a + SHINGLE - window) : b + 1] = True
        collides[a : b + 1] = True
    for a, b, _, _ in found:
        maybe[a : max(a, b - window + 1)] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([0], maybe.view(np.int8), [0]))))
    if not len(edges):
        return edges, np.empty(0, dtype=np.uint64)
    split, width = white_words(words), window - SHINGLE + 1
    low, high = edges[::2], edges[1::2] + window - 1  # words of each run of such paragraphs
    seq = Sequence([b" ".join(split[i:j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)], memo)
    first = np.argmin(np.lib.stride_tricks.sliding_window_view(seq.windows(SHINGLE), width), axis=1)
    moved = np.repeat(low - np.array(seq.starts[:-1]), np.diff(seq.starts))  # from places in seq to places in the segment
    at = np.concatenate([np.arange(i, j - window + 1) for i, j in zip(seq.starts, seq.starts[1:])])
    at = at[collides[at + first[at] + moved[at]]]
    return at + moved[at], seq.windows(window)[at]


def verified(pairs: DataFrame, held: DataFrame, similarity: float, least: int, window: int, leave: bool) -> DataFrame:
    """MATCH rows: passages of pairs that are alike, last words exclusive. With ``leave``, also a row for each document of which
    paragraphs collide outside of them: without pivot, first and last being the segment's, and with the paragraphs' hashes and
    places. The pivot's own need no second look: whatever has its key was compared with it."""
    schema = arrow_schema(MATCH)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x, y = numbered_words(r["words"], r["p_words"])
                a, c = r["low"], r["p_low"]
                lines = [(n["first"] - a, n["last"] - a, n["shift"] + a - c) for n in r["lines"]]
                found = common_passages(x, y, lines, similarity, least, window // 2)
                out += [(r["doc_id"], r["row"], a + p[0], a + p[1], r["p_doc"], r["p_row"], c + p[2], c + p[3], None, None) for p in found]
                if leave:
                    at, keys = open_paragraphs(r["words"], len(x), lines, found, window, memo)
                    if len(at):
                        out.append((r["doc_id"], r["row"], a, r["high"], None, None, None, None, keys.view(np.int64).tolist(), (at + a).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    mine = held.select("row", "low", "high", "words")
    other = held.select(F.col("row").alias("p_row"), F.col("low").alias("p_low"), F.col("high").alias("p_high"), F.col("words").alias("p_words"))
    on = ["p_row", "p_low", "p_high"]
    hot = hot_keys(pairs.groupBy(*on).agg(F.count("*").alias("n")), on, "n")
    both = join_hot(pairs.join(mine.hint("merge"), ["row", "low", "high"]), other, on, hot, F.col("row"))
    return materialize(both.select("doc_id", "row", "low", "high", "p_doc", "p_row", "p_low", "p_high", "lines", "words", "p_words").mapInArrow(check, MATCH), "matches")


def passages(docs: DataFrame, similarity: float = 0.8, least: int = 30, window: int | None = None) -> DataFrame:
    """``doc_id, row, first, last, p_doc, p_row, p_first, p_last``: a passage of a document beside the earlier one it is like."""
    window = tuned_window(similarity) if window is None else window
    keys = key_table(docs, window)
    places = collisions(keys)
    discard(keys)
    pairs = text_pairs(places)
    discard(places)
    held = segments(docs, pairs)
    found = verified(pairs, held, similarity, least, window, True)
    passage, rest = found.where("keys is null").drop("keys", "at"), found.where("keys is not null")
    each = rest.select("doc_id", "row", F.col("first").alias("low"), F.col("last").alias("high"), F.explode(F.arrays_zip("keys", "at")).alias("w"))
    each = each.groupBy(F.col("w.keys").alias("key"), "doc_id", "row", F.col("w.at").alias("at")).agg(F.min("low").alias("low"), F.max_by("high", -F.col("low")).alias("high"))
    first = F.min("at").over(Window.partitionBy("key", "doc_id", "row"))
    again = text_pairs(collisions(materialize(each.withColumn("again", F.col("at") > first), "open"), "low", "high"), "low", "high")
    if again.head(1):
        passage = passage.union(verified(again, held, similarity, least, window, False).drop("keys", "at"))
    discard(held)
    return passage


# ---------------------------------------------------------------- spans and components


def merged(spans: list[tuple[int, int, bool]]) -> list[tuple[int, list[tuple[int, int, bool]]]]:
    """Overlapping spans (first, last, removed) of one document as one node: where it begins, and its words in disjoint spans."""
    nodes: list[list] = []
    for first, last, _ in sorted(spans):
        if nodes and first < nodes[-1][1]:
            nodes[-1][1] = max(nodes[-1][1], last)
        else:
            nodes.append([first, last])
    out = []
    gone: list[list[int]] = []
    for first, last, _ in sorted(s for s in spans if s[2]):
        if gone and first <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], last)
        else:
            gone.append([first, last])
    for low, high in nodes:
        parts, at = [], low
        for a, b in ((max(a, low), min(b, high)) for a, b in gone if a < high and b > low):
            parts += ([(at, a, False)] if a > at else []) + [(a, b, True)]
            at = b
        out.append((low, parts + ([(at, high, False)] if at < high else [])))
    return out


def repeated_spans(docs: DataFrame, similarity: float = 0.8, least: int = 30, window: int | None = None) -> DataFrame:
    """``doc_id, row, first_word, last_word, n_words, component_id, removed``: disjoint spans of repeated passages.

    Words are counted from 0, last_word is the last in the span; component_id is the smallest doc_id that has a passage of its
    component, null if none has an id. Documents without a repeated passage have no row.
    """
    found = passages(docs, similarity, least, window)
    found = materialize(found.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))), "passages")
    mine = found.select("doc_id", "row", "first", "last", F.lit(True).alias("removed"))
    other = found.select(F.col("p_doc").alias("doc_id"), F.col("p_row").alias("row"), F.col("p_first").alias("first"), F.col("p_last").alias("last"), F.lit(False).alias("removed"))
    spec = "node long, doc_id long, row long, first int, last int, removed boolean, whole boolean"
    schema = arrow_schema(spec)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                spans = [(s["first"], s["last"], s["removed"]) for s in spans]
                made = merged(spans)
                starts = np.array([m[0] for m in made])
                ids = [xxhash.xxh64_intdigest(f"{row}:{low}") - (1 << 63) for low in starts.tolist()]
                out += [(n, doc, row, *part, False) for n, (_, parts) in zip(ids, made, strict=True) for part in parts]
                out += [(ids[int(np.searchsorted(starts, s[0], side="right")) - 1], doc, row, s[0], s[1], None, True) for s in {(s[0], s[1]) for s in spans}]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    # distinct first: of a passage that many share there are few different spans in its first document
    grouped = mine.union(other).distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last", "removed")).alias("spans"))
    table = materialize(grouped.mapInArrow(nodes, spec), "nodes")
    whole = table.where("whole").select("row", "first", "last", "node")
    on = ["p_row", "p_first", "p_last"]
    hot = hot_keys(found.groupBy(*on).agg(F.count("*").alias("n")), on, "n")
    links = found.join(whole.withColumnRenamed("node", "a"), ["row", "first", "last"]).select("a", *on)
    links = join_hot(links, whole.toDF(*on, "b"), on, hot, F.col("a")).select("a", "b").distinct()
    linked = connected_components(links)
    parts = table.where("not whole")
    owners = parts.groupBy("node").agg(F.min("doc_id").alias("doc"))
    classes = owners.join(linked, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    classes = materialize(classes, "classes")
    firsts = materialize(classes.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("n")), "firsts")
    classes = join_hot(classes.select("node", "component"), firsts.drop("n"), ["component"], hot_keys(firsts, ["component"], "n"), F.col("node"))
    out = parts.join(classes, "node")
    return out.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "row", F.col("first").cast("long").alias("first_word"), (F.col("last") - 1).cast("long").alias("last_word"),
        (F.col("last") - F.col("first")).cast("long").alias("n_words"), F.nullif("component_id", F.lit(LAST)).alias("component_id"), "removed",
    )


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the words of all removals taken out of their texts, together with the white space before each; the rest stays as it was."""
    cut = repeated_spans(docs, **parameters).where("removed").groupBy("row").agg(F.collect_set(F.struct("first_word", "last_word")).alias("__cut"))
    held = packed(docs, F.xxhash64("doc_id", "text").alias("row")).join(cut, "row", "left")

    @F.pandas_udf("string")
    def trimmed(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if c is None else cut_words(t, [(s["first_word"], s["last_word"]) for s in c]) for t, c in zip(text, cuts, strict=True)])

    text = F.when(F.col("__cut").isNull(), F.col("__packed.text")).otherwise(trimmed(F.col("__packed.text"), F.col("__cut")))
    return unpacked(held, docs, {"text": text})


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    gone = {i for a, b in spans for i in range(a, b + 1)}
    out, at = [], 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i not in gone:
            out.append(text[at : m.end()])
        at = m.end()
    return "".join(out) + text[at:]
