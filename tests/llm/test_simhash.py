import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, rows, with_clash
from weftline.llm.simhash import block_masks, drop_near_duplicates, fingerprint, simhash_near_duplicates, spanning_links


def plain_fingerprint(text, k=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, unsigned) pairs; doc_id -> smallest reachable, row by row."""
    at = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                at = [at[j] if x == at[i] else x for x in at]
    least = {}
    for (d, _), c in zip(prints, at):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return [(d, f"{p:016x}", least.get(c)) for (d, p), c in zip(prints, at)]


def texts(n, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "A-b", " x"]
    base = [" ".join(r.choices(words, k=r.choice([1, 3, 4, 5, 60, 90]))) for _ in range(n)]
    near = [b.replace("w1 ", "w2 ", 1) for b in base if len(b) > 150]
    return base + near + [b.upper() for b in base[:9]]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60)))
def test_fingerprint_is_the_plain_one(text):
    assert fingerprint((text or "").encode()) % (1 << 64) == plain_fingerprint(text)


def test_masks_let_every_close_pair_meet():
    r = random.Random(1)
    for blocks in range(5, 11):
        masks = block_masks(blocks, 4)
        for _ in range(200):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_spanning_links_connect_what_pairs_connect():
    r = random.Random(2)
    at = [r.getrandbits(64) for _ in range(4)]
    values = [c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in at for _ in range(60)]
    links = spanning_links(np.array(values, dtype=np.uint64).view(np.int64), 4)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
    whole = {c for _, _, c in plain_components(list(enumerate(sorted(set(values)))))}
    assert len(links) == len(set(values)) - len(whole)


def test_groups_as_brute_force(spark):
    docs = list(enumerate(texts(120), start=10)) + ODD + [(7, "one two three four five six seven")] * 3
    got = simhash_near_duplicates(with_clash(documents(spark, docs), "fingerprint", "fp", "component_id", "key"))
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    assert sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()))) == sorted(map(repr, expected))


def test_large_buckets_and_chunks(spark):
    from pyspark.sql import functions as F

    from weftline.llm.common import connected_components
    from weftline.llm.simhash import close_links

    r = random.Random(3)
    centre = r.getrandbits(63)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 4))) for _ in range(300)} | {r.getrandbits(63) for _ in range(100)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for few, chunk in ((4, 16), (4, 1000), (1000, 1000)):
        got = {x.node: x.component for x in connected_components(close_links(frame, 4, few, chunk)).collect()}
        assert [got.get(v, v) for v in values] == [c for _, _, c in plain_components([(v, v) for v in values])]
    assert frame.where(F.col("fp").isNull()).count() == 0


def test_empty_table(spark):
    assert simhash_near_duplicates(documents(spark, [])).count() == 0
    assert drop_near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"v{i}" for i in range(200))
    docs = [(3, long), (9, long), (2, long.replace("v100 ", "")), (5, "alpha beta gamma delta epsilon"), (5, "other words that have nothing shared"), (5, "alpha beta gamma delta epsilon"), (None, "only null ids here"), (1, None), (8, "")]
    out = rows(drop_near_duplicates(with_clash(documents(spark, docs), "component", "fp")))
    assert sorted((repr(r["doc_id"]), r["text"]) for r in out if r["doc_id"] not in (1, 2)) == [("5", "alpha beta gamma delta epsilon"), ("5", "other words that have nothing shared"), ("None", "only null ids here")]
    assert [r["text"] for r in out if r["doc_id"] == 2] == [docs[2][1]]
    assert [r["doc_id"] for r in out if not r["text"]] == [1]
    assert set(out[0]) == {"doc_id", "text", "lang", "source", "n_chars", "component", "fp"}


def test_ids_on_several_texts_keep_only_rows_of_their_components(spark):
    a, b, c = ("one two three four five six seven", "many other words are in this text here", "and this last one is about something else")
    rows = [(3, b), (5, a), (5, b), (None, c), (None, b), (7, "x y z w")]
    got = drop_near_duplicates(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(3, b), (5, a), (None, c), (7, "x y z w")], key=repr)
