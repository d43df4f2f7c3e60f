import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm.language import Filters, grams, held_out, language_of_documents, letters, predict, text_grams, train


def test_filters_miss_nothing_and_err_as_computed():
    r = np.random.default_rng(1)
    profiles = {f"l{i:02d}": r.integers(0, 1 << 63, 500).astype(np.uint64) for i in range(70)}  # more than a word of bits
    f = Filters.of(profiles)
    assert f.slots.shape[1] == 2
    for i, lang in enumerate(f.langs):
        assert f.counts(profiles[lang])[i] == 500
    strange = r.integers(0, 1 << 63, 200_000).astype(np.uint64)
    assert np.allclose(f.counts(strange) / len(strange), f.false_positive, atol=0.002)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_grams_are_those_of_plain_runs(text):
    runs = "".join(c if c.isalpha() else "\0" for c in text.lower())
    while "\0\0" in runs:
        runs = runs.replace("\0\0", "\0")
    points = "".join(map(chr, letters(text).tolist()))
    assert points.strip("\0") == runs.strip("\0") and points[0] == points[-1] == "\0"
    for n in (2, 3, 4):
        plain = [points[i : i + n] for i in range(len(points) - n + 1) if "\0" not in points[i + 1 : i + n - 1]]
        codes = grams(letters(text), n).tolist()
        assert len(codes) == len(plain) and len(set(codes)) == len(set(plain))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in language_of_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    mine = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out == (d in set(mine)) for d, r in out.items())
    assert sum(out[d].lang_pred == truth[d] for d in mine) >= 0.97 * len(mine)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_the_text_counts_and_odd_rows(spark):
    rows = [(100 + i, "the cat and the dog", "en", "a") for i in range(9)] + [(200 + i, "der hund und die katze", "de", "b") for i in range(9)]
    docs = documents(spark, rows)
    filters = train(docs)
    odd = with_clash(documents(spark, [*ODD, (7, "123 !?"), (8, "und die katze"), (9, "the dog")]), "lang_pred", "score", "held_out")
    got = [(r.doc_id, r.lang_pred) for r in predict(odd, filters).collect()]
    assert (8, "de") in got and (9, "en") in got and (7, "und") in got and (1, "und") in got and (2, "und") in got and len(got) == len(ODD) + 3
    assert all(r.lang_pred == "und" for r in language_of_documents(odd).collect() if r.doc_id in (1, 2, 3, 7))
    assert {r.lang_pred for r in language_of_documents(odd).collect()} == {"und"}  # no language to learn from
    assert language_of_documents(documents(spark, [])).count() == 0
    assert odd.where(held_out()).where("doc_id is null").count() == 0


def test_long_texts_whole():
    f = Filters.of({"aa": np.unique(text_grams("abc abd")), "zz": np.unique(text_grams("xyz xyw"))})
    assert f.decide("abc " * 300_000 + "xyz " * 400_000)[0] == "zz"


def test_filters_against_plain_sets(spark):
    """Predictions as with one set of n-grams a language, which has no false positives, but where two languages nearly tie."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    seen = {}
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(d).encode()) % 5:
            for g in set(text_grams(text).tolist()):
                seen.setdefault(lang, {}).setdefault(g, 0)
                seen[lang][g] += 1
    sets = {}
    for lang, times in seen.items():
        order = sorted(times, key=lambda g: (-times[g], g - (1 << 64) if g >> 63 else g))
        sets[lang] = set(order[:4000])
    out = {r.doc_id: r for r in language_of_documents(docs, texts_per_lang=10**9, grams_per_lang=4000).collect()}
    for d, text, _ in rows:
        codes = text_grams(text or "").tolist()
        if not any(c.isalpha() for c in text or ""):
            assert out[d].lang_pred == "und"
            continue
        share = {lang: sum(g in s for g in codes) / len(codes) for lang, s in sets.items()}
        best = max(sorted(share), key=share.__getitem__)
        assert abs(out[d].score - share[best]) < 0.05
        assert out[d].lang_pred == best or share[best] - share[out[d].lang_pred] < 0.03


def test_profiles_are_the_most_frequent_whatever_the_parts(spark):
    rows = [(i, " ".join("abcdefgh"[(i * j) % 8] * 3 for j in range(30)), "xx", "s") for i in range(40)]
    f = train(documents(spark, rows), grams_per_lang=7)
    times = {}
    for _, t, *_ in rows:
        for g in set(text_grams(t).tolist()):
            times[g] = times.get(g, 0) + 1
    best = sorted(times, key=lambda g: (-times[g], g - (1 << 64) if g >> 63 else g))[:7]
    assert f.counts(np.array(best, dtype=np.uint64))[0] == 7
