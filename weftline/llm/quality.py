"""Quality rules as a short-circuit cascade: cost and selectivity of each rule are estimated on a sample, then rules run in
the order of rejections per cost, and a document meets no further rule once one rejects it.

The order changes what a run costs, never what it keeps. A null text has no words and fails the first rule; a text of white
space alone does too. Rows with equal doc_id are judged each by its own text. Any further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count
from time import perf_counter_ns

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, map_rows, map_texts, texts, white_words

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5


class Signals:
    """What rules look at, each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return white_words(self.text)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, WHITE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if not line.isspace() and line]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five that occur twice or more in the text, compared exactly."""
        n, first = len(self.words), {}
        if n <= WINDOW:
            return 0
        ids = np.array(list(map(first.setdefault, self.words, count())), dtype=np.int64)
        if len(first) == n:
            return 0
        bits, held = n.bit_length(), 1
        code = ids[: n - WINDOW + 1]
        for j in range(1, WINDOW):
            if bits * (held + 1) > 63:
                code, held = np.unique(code, return_inverse=True)[1], 1
            code, held = (code << bits) | ids[j : n - WINDOW + 1 + j], held + 1
        _, which, times = np.unique(code, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        covered = np.zeros(n, dtype=bool)
        for j in range(WINDOW):
            covered[j : j + len(twice)] |= twice
        return int(covered.sum())

    @cached_property
    def shouted(self) -> float:
        """Share of A-Z among the letters a-z and A-Z."""
        small = len(self.text) - len(self.text.translate(None, bytes(range(97, 123))))
        large = len(self.text) - len(self.text.translate(None, bytes(range(65, 91))))
        return large / max(1, small + large)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Signals], bool]


#: The first two are the base; the others leave anything but plain junk alone.
BASE = (
    Rule("few_words", lambda s: len(s.words) < 10),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 20 * len(s.words)),
)
RULES = (
    *BASE,
    Rule("symbols", lambda s: 5 * s.n_symbols > len(s.words)),
    Rule("repeated_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("shouting", lambda s: s.shouted > 0.5),
    Rule("endless_words", lambda s: s.word_chars > 100 * len(s.words)),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[dict]:
    """Nanoseconds and rejections of each rule alone over about ``sample_rows`` documents, dealt by the hash of the text.

    Each rule is timed on signals of its own, so that none is cheap because another one ran before. Tables of fewer rows
    are measured whole.
    """
    share = sample_rows / max(1, docs.count())
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else docs

    def measured(text: bytes) -> tuple:
        out = []
        for rule in rules:
            began = perf_counter_ns()
            out += [int(rule.rejects(Signals(text))), perf_counter_ns() - began]
        return tuple(out)

    spec = ", ".join(f"r{i} long, t{i} long" for i in range(len(rules)))
    sums = map_texts(sample, ["text"], measured, spec).agg(F.count("*").alias("n"), *(F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(rules)) for c in "rt")).first()
    return [{"name": rule.name, "rows": sums["n"], "rejected": sums[f"r{i}"] or 0, "ns": sums[f"t{i}"] or 0} for i, rule in enumerate(rules)]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> tuple[Rule, ...]:
    """The rules by rejections per nanosecond, most first; ties keep the order given."""
    found = {e["name"]: e["rejected"] / max(1, e["ns"]) for e in estimate(docs, rules, sample_rows)}
    return tuple(sorted(rules, key=lambda r: -found[r.name]))


def expected_ns(found: list[dict], order: tuple[Rule, ...]) -> float:
    """What a document costs in a cascade of this order, by estimates of its rules, were they independent."""
    by, reached, total = {e["name"]: e for e in found}, 1.0, 0.0
    for rule in order:
        e = by[rule.name]
        total += reached * e["ns"] / max(1, e["rows"])
        reached *= 1 - e["rejected"] / max(1, e["rows"])
    return total


def passes(text: bytes, order: tuple[Rule, ...]) -> bool:
    signals = Signals(text)
    return not any(rule.rejects(signals) for rule in order)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    order = ordered(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(t, order) for t in texts(batch, "text")], type=pa.bool_()))

    return map_rows(docs, run)


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``doc_id``, the base signals, ``base_failed`` and ``kept`` of every row.

    The signals are asked for whether a rule needs them or not; the cascade runs over the documents that the base rules leave, and
    without these. keep_good() has the whole of it.
    """
    order = tuple(rule for rule in ordered(docs, rules, sample_rows) if rule not in BASE)

    def row(text: bytes) -> tuple:
        s = Signals(text)
        failed = any(rule.rejects(s) for rule in BASE)
        return len(s.words), s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, not failed and not any(rule.rejects(s) for rule in order)

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
