"""Language identification with n-gram filters that answer for all languages at once.

Training counts letter n-grams of labelled texts and programs each language's most frequent ones into a bit-sliced Bloom
filter: a table of slots that hold one bit for each language, so the bitwise and of an n-gram's slots is the set of all
languages that contain it, false positives included. A text's language is the one with the highest count of its n-grams
after the expected false positives, from the share of a language's bits that are set, are taken off.

A text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned. Ties go to the language that is first
in byte order. Training rows need a text and a language; their number for each language is bounded by a parameter, and so is
that of a language's n-grams, so the model, which the driver and every task hold, grows with the number of languages alone.
Repeated rows are predicted alike; they count each in training. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_texts

SIZES = (2, 3, 4)
#: Very long texts are read in pieces of so many characters.
PIECE = 1 << 20
#: A language's n-grams are ranked in so many parts.
DEALS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one 0, with a 0 at both ends."""
    lower = text.lower()
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letter_table()[np.minimum(points, 0x110000 - 1)]
    points = np.concatenate(([0], np.where(is_letter, points, 0), [0])).astype(np.uint64)
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _TABLE[0]


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that hold a letter run's inside and edges; those across a gap have its 0 in the middle and go."""
    if len(points) < n:
        return np.empty(0, dtype=np.uint64)
    windows = [points[j : len(points) - n + 1 + j] for j in range(n)]
    code = np.full(len(windows[0]), n, dtype=np.uint64)
    for w in windows:
        code = (code ^ w) * MIX
        code ^= code >> np.uint64(29)
    inside = np.ones(len(code), dtype=bool)
    for w in windows[1:-1]:
        inside &= w != 0
    return code[inside]


def text_grams(text: str) -> np.ndarray:
    points = letters(text)
    return np.concatenate([grams(points, n) for n in SIZES])


def gram_pieces(text: str) -> Iterator[np.ndarray]:
    """text_grams() of a text of any length, in overlapping pieces."""
    for at in range(0, len(text), PIECE):
        yield text_grams(text[at : at + PIECE + max(SIZES)])


def distinct_grams(text: str) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *map(np.unique, gram_pieces(text))]))


@dataclass
class Filters:
    """slots: one row of 64-bit words for each slot, a bit for each language; false_positive: of each language."""

    langs: list[str]
    slots: np.ndarray
    hashes: int
    false_positive: np.ndarray

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray], hashes: int = 3, slots_per_gram: int = 12) -> Filters:
        langs = sorted(profiles, key=str.encode)
        most = max((len(p) for p in profiles.values()), default=1)
        size = 1 << max(10, (slots_per_gram * most - 1).bit_length())
        slots = np.zeros((size, max(1, (len(langs) + 63) // 64)), dtype=np.uint64)
        for i, lang in enumerate(langs):
            for k in range(hashes):
                slots[cls._at(profiles[lang], k, size), i // 64] |= np.uint64(1 << (i % 64))
        filled = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        return cls(langs, slots, hashes, filled**hashes)

    @staticmethod
    def _at(codes: np.ndarray, k: int, size: int) -> np.ndarray:
        bits = size.bit_length() - 1
        return ((codes * np.uint64(2 * k + 1) + (codes >> np.uint64(32)) * np.uint64(k)) * MIX >> np.uint64(64 - bits)).astype(np.int64)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter says it contains."""
        held = self.slots[self._at(codes, 0, len(self.slots))]
        for k in range(1, self.hashes):
            held &= self.slots[self._at(codes, k, len(self.slots))]
        out = np.zeros(len(self.langs), dtype=np.int64)
        for word in range(held.shape[1]):
            masks, times = np.unique(held[:, word], return_counts=True)
            for i in range(64 * word, min(len(self.langs), 64 * word + 64)):
                out[i] = times[(masks >> np.uint64(i - 64 * word)) & np.uint64(1) == 1].sum()
        return out

    def decide(self, text: str) -> tuple[str, float]:
        """The language and its corrected share of the n-grams, 0 to 1."""
        if not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        seen = 0
        for codes in gram_pieces(text):
            seen += len(codes)
            total += self.counts(codes)
        share = np.clip((total / max(1, seen) - self.false_positive) / (1 - self.false_positive), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], round(float(share[best]), 6)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, texts_per_lang: int = 2000, grams_per_lang: int = 4000) -> Filters:
    """Filters learned from rows of docs with a text and a lang.

    Each language gives about ``texts_per_lang`` whole texts, dealt by hash: the bound on the training sample. An n-gram counts
    once for each text, so no long text makes a profile.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters.of({})
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, texts_per_lang / n)))))
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    schema = arrow_schema("lang string, gram long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(distinct_grams(text))
            for lang, found in by.items():
                codes, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(times)], schema=schema)

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(F.desc("n"), "gram"))  # first by parts, then of their best
    parts = counts.withColumn("deal", F.pmod("gram", F.lit(DEALS))).withColumn("rank", best).where(F.col("rank") <= grams_per_lang)
    top = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= grams_per_lang)
    profiles: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return Filters.of({lang: np.array(g, dtype=np.int64).view(np.uint64) for lang, g in profiles.items()})


def predict(docs: DataFrame, filters: Filters, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ``lang_pred, score`` of every row of docs; only its text is looked at."""
    spec = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, ".replace("bigint", "long") for c in columns) + "lang_pred string, score double"
    return map_texts(docs, [*columns, "text"], lambda t: filters.decide(t.decode("utf-8", "replace")), spec)


def language_of_documents(docs: DataFrame, texts_per_lang: int = 2000, grams_per_lang: int = 4000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learned from the rows that are not held out."""
    filters = train(docs.where(~held_out()), texts_per_lang, grams_per_lang)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), filters, ("doc_id", "held_out"))
