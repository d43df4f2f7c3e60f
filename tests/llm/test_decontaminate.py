import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, rows, with_clash
from weftline.llm.decontaminate import Phrases, contamination, remove_contamination, shard_hits
from weftline.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

ITEMS = "item_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window):
    out = []
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                p = w[i : i + window]
                for at in range(len(words) - len(p) + 1):
                    if words[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found.add("" if item is None else str(item))
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60))
def test_suffix_array_and_wavelet_ranks(symbols):
    text = np.array([*symbols, 0], dtype=np.int64)
    marks = [(-1000 + i, 0) if s == 0 else (s, 0) for i, s in enumerate(text)]
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: marks[i:])
    tree = WaveletMatrix(text, 3)
    at = np.arange(len(text) + 1)
    for c in range(6):
        assert tree.rank(np.full(len(at), c), at).tolist() == [int((text[:i] == c).sum()) for i in at]
    got, before = tree.access(at[:-1])
    assert got.tolist() == text.tolist() and before.tolist() == [int((text[:i] == c).sum()) for i, c in enumerate(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 9))
def test_search_and_locate(symbols, phrase, sample):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = FMIndex(text, 4, sample)
    low, high = index.search(np.array([phrase, phrase], dtype=np.int64))
    found = sorted(index.locate(np.arange(low[1], high[1])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=14).map(" ".join), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcdx"), max_size=40).map(" ".join), min_size=1, max_size=4), st.integers(1, 5))
def test_shards_as_brute_force(items, docs, window):
    made = shard_hits([d.encode() for d in docs], Phrases([(i, t.encode()) for i, t in enumerate(items)], window), sample=3)
    got = [(i, n, sum(s[1::2]) - sum(s[::2]), len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest(), bool(s)) for i, (n, s, x) in enumerate(zip(*made))]
    assert sorted(got, key=repr) == plain(list(enumerate(docs)), list(enumerate(items)), window)


def fixture():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 9, 10, 11, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, " - "), (9, "w1 w2 w3 w4"), (None, "w5 w6 w7 w8 w9")]
    docs = [(100 + i, " ".join(r.choices(vocabulary, k=80))) for i in range(30)]
    docs += [(200 + i, "Lead in, " + t.upper().replace("É", "É") + "; " + docs[i][1]) for i, (_, t) in enumerate(items) if t]
    docs += [(300, items[4][1] + " " + items[4][1]), (300, items[4][1] + " " + items[4][1])]
    return docs + ODD, items


def test_contamination_as_brute_force(spark):
    docs, items = fixture()
    expected = plain(docs, items, 10)
    assert any(r[-1] for r in expected)
    frame, benchmark = with_clash(documents(spark, docs), "n_hit", "item_id"), with_clash(spark.createDataFrame(items, ITEMS), "doc_id", "n_words")
    for block_bytes in (1 << 20, 100):
        got = sorted((tuple(r) for r in contamination(frame, benchmark, 10, block_bytes).collect()), key=repr)
        assert got == expected


def test_removal(spark):
    docs, items = fixture()
    clean = sorted((r[0] for r in plain(docs, items, 10) if not r[-1]), key=repr)
    frame = with_clash(documents(spark, docs), "n_hit")
    for block_bytes in (1 << 20, 100):
        out = remove_contamination(frame, spark.createDataFrame(items, ITEMS), 10, block_bytes)
        assert sorted((r["doc_id"] for r in rows(out)), key=repr) == clean and out.schema == frame.schema


def test_empty_tables(spark):
    docs, items = fixture()
    none, benchmark = spark.createDataFrame([], ITEMS), spark.createDataFrame(items, ITEMS)
    assert contamination(documents(spark, []), benchmark).count() == 0
    assert contamination(documents(spark, docs), none).where("contaminated").count() == 0
    assert remove_contamination(documents(spark, docs), none).count() == len(docs)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()], 10)
    assert sorted((tuple(r) for r in contamination(docs, benchmark).collect()), key=repr) == expected
