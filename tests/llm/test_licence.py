import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm.licence import BASE_PHRASES, LicenceIndex, corpus_index, licence_matches, licence_scan, templates

INDEX = LicenceIndex(templates())


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "General", "PUBLIC", "license", "apache", "CC", "by", "mit", "x", "É", "nc", "-", "version", "2"]), max_size=30), st.sampled_from([" ", "-", "\n", ". "]))
def test_base_places_are_all_found(words, gap):
    text = gap.join(words)
    n, base, _ = INDEX.scan(text.encode())
    assert (n, sorted((s, INDEX.templates[i].label) for s, i in base)) == plain(text)


def test_notices_have_their_labels():
    for t in INDEX.templates:
        found = {}
        for label, _, score in INDEX.scan(b"so it begins " + b" ".join(t.words) + b" and it ends")[2]:
            found[label] = max(score, found.get(label, 0))
        assert found[t.label] > 0.99, t.label


def test_a_notice_with_a_word_changed_and_without_its_key():
    text = "Permission is hereby granted, free of charge, to any one person obtaining a copy of this program and associated documentation files, to deal in the Software without restriction"
    assert any(m[0] == "mit" and 0.6 < m[2] < 1 for m in INDEX.scan(text.encode())[2])
    assert not INDEX.scan(text.replace("without restriction", "with restrictions").encode())[2]


def labels(text):
    return {m[0] for m in INDEX.scan(text.encode())[2]}


def test_headers_tags_names_and_addresses():
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert labels(gpl) == {"gpl", "gpl-3.0"}
    assert labels(gpl.replace("version 3", "version 2")) == {"gpl", "gpl-2.0"}
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later */") == {"gpl-2.0-or-later"}
    assert labels("# SPDX-License-Identifier: MIT") == {"mit"} and labels("# SPDX-License-Identifier: MIT-0") == {"mit-0"}
    assert labels("see https://www.apache.org/licenses/LICENSE-2.0 for it") == {"apache-2.0"}
    assert labels("Creative Commons Attribution-NonCommercial 4.0") == {"cc-by-nc"}
    assert labels("https://creativecommons.org/licenses/by-nc-sa/4.0/") == {"cc-by-nc-sa"}
    assert labels("CC BY-NC-SA 4.0") == {"cc-by", "cc-by-nc-sa"}
    assert labels("a license of the public by the general, mit and gnu version") == set()


def test_frequencies_of_the_corpus_choose_the_rare_words(spark):
    docs = [(i, "the mozilla mozilla foundation and its source code") for i in range(50)] + [(99, "Mozilla Public License"), (100, None)]
    index = corpus_index(documents(spark, docs))
    at = next(i for i, t in enumerate(index.templates) if t.words == (b"mozilla", b"public", b"license"))
    assert index.rare[at][0] != b"mozilla" and LicenceIndex(templates()).rare[at][0] == b"mozilla"
    assert [m[0] for m in index.scan(b"the mozilla public license")[2]] == ["mpl"]
    out = {r.doc_id: r.labels for r in licence_scan(documents(spark, docs)).collect()}
    assert out[99] == "mpl" and {out[i] for i in range(50)} == {""}


def test_scan(spark):
    docs = [(10, "Licensed under the Apache License, Version 2.0. And the MIT license too."), (11, "gnu general public"), (12, "under CC-BY-NC 4.0"), *ODD]
    out = {r.doc_id: r for r in licence_scan(with_clash(documents(spark, docs), "labels", "score")).collect()}
    assert (out[10].n_words, out[10].n_base, out[10].first_word, out[10].last_word, out[10].base_labels, out[10].labels, out[10].score) == (13, 2, 3, 10, "apache,mit", "apache,apache-2.0,mit", 1.0)
    assert (out[11].n_base, out[11].first_word, out[11].labels, out[11].score) == (0, None, "", 0.0)
    assert (out[12].base_labels, out[12].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert (out[1].n_words, out[2].n_words, out[5].n_words) == (0, 0, 30_000)
    assert licence_scan(documents(spark, docs)).count() == len(docs) and licence_scan(documents(spark, [])).count() == 0
    assert licence_matches(documents(spark, docs)).where("doc_id = 12").first().starts == [1, 1]


def test_whole_table_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in licence_scan(docs).collect()}
    for r in docs.collect():
        n, places = plain(r.text)
        got = out[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (n, len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
