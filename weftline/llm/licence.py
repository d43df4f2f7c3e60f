"""Licence scan: a positional index of rare licence words.

Templates are the base phrases, short licence notices, licence names, SPDX tags and licence addresses. Of the words that
templates have, document frequencies are counted over the whole corpus; the index posts each template's rarest words with their
positions. A file's licence words are looked up from the rarest on, templates without their rarest word in the file fall out, postings
are intersected by relative position (word position minus position in the template), and a template that enough rare words agree on
is verified: its mandatory key phrases must stand where the template is. Of templates that begin at one place, one that
another, longer one begins with gives way, but base phrases stay.

A null or empty text has no words and no label. Ties in rarity go to the word first in byte order. Repeated rows are judged alike, each
by its own text; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_schema, map_texts, texts

# ------------------------------------------------------------------------------------------------------------
# The base phrases with their labels, and openings or key clauses of well-known licence notices.
# A notice gives its label, its text and the phrases of it that must all be there.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("neither the name of", "to endorse or promote products derived from this software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license as published by", "version 2 of the license")),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by", "version 3 of the license")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license as published by", "version 2 1 of the license")),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license as published by", "version 3 of the license")),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license as published by", "version 3 of the license")),
    ("gfdl", "gnu free documentation license", ("gnu free documentation license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("commons attribution 4 0 international",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "boost software license version 1 0", ("boost software license",)),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license 2 0", ("artistic license 2 0",)),
)
#: Licences by name, address and SPDX identifier; a name or address that another one begins with gives way to it.
NAMES = {
    "mit license": "mit", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc license": "isc", "zlib license": "zlib", "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0", "eclipse public license": "epl", "eclipse public license v 2 0": "epl-2.0", "apache software license": "apache", "european union public licence": "eupl",
    "open data commons open database license": "odbl", "sil open font license": "ofl", "do what the fuck you want to public license": "wtfpl", "public domain dedication": "public-domain",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution noncommercial sharealike": "cc-by-nc-sa", "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "apache org licenses license 2 0": "apache-2.0", "opensource org licenses mit": "mit", "opensource org licenses bsd": "bsd", "opensource org licenses isc": "isc", "opensource org license mit": "mit", "mozilla org mpl 2 0": "mpl-2.0",
    "gnu org licenses gpl": "gpl", "gnu org licenses gpl 2 0": "gpl-2.0", "gnu org licenses gpl 3 0": "gpl-3.0", "gnu org licenses lgpl": "lgpl", "gnu org licenses agpl": "agpl", "unlicense org": "unlicense",
    "creativecommons org licenses by": "cc-by", "creativecommons org licenses by sa": "cc-by-sa", "creativecommons org licenses by nc": "cc-by-nc", "creativecommons org licenses by nd": "cc-by-nd", "creativecommons org licenses by nc sa": "cc-by-nc-sa", "creativecommons org licenses by nc nd": "cc-by-nc-nd", "creativecommons org publicdomain zero": "cc0",
}
SPDX = "MIT MIT-0 Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense Zlib BSL-1.0 0BSD".split()
# ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # mandatory phrases and where they stand in the template
    base: bool


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(alnum_words(text.encode()))


def _find(words: tuple[bytes, ...], phrase: tuple[bytes, ...]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates(phrases: dict[str, str] = BASE_PHRASES, notices=NOTICES, names: dict[str, str] = NAMES, spdx: list[str] = SPDX) -> list[Template]:
    out = [Template(label, _words(p), ((0, _words(p)),), True) for p, label in phrases.items()]
    named = {**names, **{f"spdx license identifier {x}": x.lower() for x in spdx}}
    for label, text, keys in (*notices, *((label, text, (text,)) for text, label in named.items())):
        words = _words(text)
        out.append(Template(label, words, tuple((_find(words, _words(k)), _words(k)) for k in keys), False))
    return out


class LicenceIndex:
    """Postings of each template's rarest words: word -> (template, position) pairs. frequency: how many of ``rows`` documents have
    each word that a template has; words it has nothing of are the rarest."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int] | None = None, rows: int = 0, rare: int = 4, slack: int = 4):
        self.templates, self.slack = found, slack
        holding = Counter(w for t in found for w in set(t.words))
        inside = {w: log((1 + len(found)) / n) for w, n in holding.items()}
        frequency = frequency or {}
        self.idf = {w: log((1 + rows) / (1 + frequency.get(w, 0))) + inside[w] for w in holding}
        self.order = {w: i for i, w in enumerate(sorted(holding, key=lambda w: (-self.idf[w], w)))}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[list[bytes]] = []
        for i, t in enumerate(found):
            best = sorted(set(t.words), key=self.order.__getitem__)[: 1 if t.base else rare]
            self.rare.append(best)
            for at, w in enumerate(t.words):
                if w in best:
                    self.postings[w].append((i, at))
        self.keys = frozenset(self.postings)
        self.longer = [[j for j, other in enumerate(found) if len(other.words) > len(t.words) and other.words[: len(t.words)] == t.words] for t in found]

    def scan(self, text: bytes) -> tuple[int, list[int], list[tuple[str, int, float]]]:
        """Words of the text, starts of base phrases as (start, template), and (label, start, score) of all matches."""
        words = alnum_words(text)
        held = sorted(self.keys.intersection(words), key=self.order.__getitem__)
        if not held:
            return len(words), [], []
        alive = {i for w in held for i, _ in self.postings[w] if self.rare[i][0] == w}
        places: dict[bytes, list[int]] = {w: [] for w in held}
        for at, w in enumerate(words):
            if w in places:
                places[w].append(at)
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for w in held:  # from the rarest on
            for i, offset in self.postings[w]:
                if i in alive:
                    for at in places[w]:
                        if at >= offset:
                            votes[i][at - offset].add(w)
        base, matches = [], []
        for i, starts in votes.items():
            t = self.templates[i]
            if t.base:
                for start in starts:
                    if tuple(words[start : start + len(t.words)]) == t.words:
                        base.append((start, i))
                        matches.append((i, start, 1.0))
                continue
            need = max(1, len(self.rare[i]) // 2)
            for start in sorted(starts):
                near = set().union(*(starts.get(s, ()) for s in range(start - self.slack, start + self.slack + 1)))
                if len(near) >= need and all(self._stands(words, start + at, key) for at, key in t.keys):
                    matches.append((i, start, self._score(words, start, t)))
        there = {(i, start) for i, start, _ in matches}
        kept = [m for m in matches if self.templates[m[0]].base or not any((j, m[1]) in there for j in self.longer[m[0]])]
        return len(words), base, [(self.templates[i].label, start, score) for i, start, score in kept]

    def _stands(self, words: list[bytes], at: int, key: tuple[bytes, ...]) -> bool:
        return any(tuple(words[s : s + len(key)]) == key for s in range(max(0, at - self.slack), at + self.slack + 1))

    def _score(self, words: list[bytes], start: int, t: Template) -> float:
        """Share of the template's words, weighed by idf, that the text has there in any order."""
        here = Counter(words[max(0, start - self.slack) : start + len(t.words) + self.slack])
        wanted = Counter(t.words)
        whole = sum(self.idf[w] * n for w, n in wanted.items())
        return sum(self.idf[w] * min(n, here[w]) for w, n in wanted.items()) / whole if whole else 0.0


def corpus_index(docs: DataFrame, found: list[Template] | None = None) -> LicenceIndex:
    """The index by document frequencies in all rows of docs: sums by task, of the few words that templates have."""
    found = templates() if found is None else found
    vocabulary = frozenset(w for t in found for w in t.words)
    schema = arrow_schema("word binary, n long, rows long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in texts(batch, "text"):
                times.update(vocabulary.intersection(alnum_words(text)))
        out = [*times.items(), (b"", 0)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], type=pa.binary()), pa.array([n for _, n in out]), pa.array([0] * (len(out) - 1) + [rows])], schema=schema)

    sums = docs.select("text").mapInArrow(count, "word binary, n long, rows long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    return LicenceIndex(found, {bytes(r.word): r.n for r in sums if r.word}, sum(r.rows for r in sums))


def licence_matches(docs: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """``doc_id, n_words`` and the matches of each document: labels, first words and scores, in order of their first word."""
    index = corpus_index(docs, found)

    def row(text: bytes) -> tuple:
        n, _, matches = index.scan(text)
        matches = sorted(set(matches), key=lambda m: (m[1], m[0]))
        return n, [m[0] for m in matches], [m[1] for m in matches], [round(m[2], 6) for m in matches]

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, n_words long, labels array<string>, starts array<long>, scores array<double>")


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places and labels, and the labels of the whole index with the best score."""
    index = corpus_index(docs)

    def row(text: bytes) -> tuple:
        n, base, matches = index.scan(text)
        names = sorted({index.templates[i].label for _, i in base})
        starts = [s for s, _ in base]
        return (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(sorted({*names, *(m[0] for m in matches)})), round(max((m[2] for m in matches), default=0.0), 6))

    return map_texts(docs, ["doc_id", "text"], row, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
