import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm.paragraphs import SHINGLE, Sequence, Words, band_keys, common_passages, cut_words, merged, numbered_words, repeated_spans, shingle_codes, sliding_least, tuned_window, without_repeats

WINDOW, LEAST = 24, 30


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(r, n):
    return " ".join(r.choice("abcdefghij") + str(r.randrange(4000)) for _ in range(n))


def shingles(words):
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def spans_of(spark, rows, **parameters):
    """By document: marked and removed words, and component ids."""
    marked, removed, ids = defaultdict(set), defaultdict(set), defaultdict(set)
    for x in repeated_spans(documents(spark, rows), **parameters).collect():
        span = set(range(x.first_word, x.last_word + 1))
        assert x.n_words == len(span) and not span & marked[x.doc_id]  # disjoint
        marked[x.doc_id] |= span
        ids[x.doc_id].add(x.component_id)
        removed[x.doc_id] |= span if x.removed else set()
    return marked, removed, ids


def test_window_is_what_similar_passages_share():
    assert tuned_window(0.8) == WINDOW
    r = random.Random(1)
    for n in [*range(30, 130), 200, 300]:
        base = prose(r, n).split()
        for _ in range(20):
            near = list(base)
            for at in r.sample(range(n), r.randrange(1, 7)):
                near[at] = "changed"
            if similarity(base, near) >= 0.8:
                same = "".join("01"[a == b] for a, b in zip(base, near))
                assert max(map(len, same.split("0"))) >= min(n, WINDOW)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), min_size=1, max_size=4), st.integers(5, 9))
def test_equal_paragraphs_have_equal_keys(docs, window):
    seq = Sequence([d.encode() for d in docs], Words())
    doc, key, at, again = (x.tolist() for x in band_keys(seq, window))
    keys, values = defaultdict(set), seq.windows(SHINGLE)
    for d, k, a, g in zip(doc, key, at, again):
        assert g == (k in keys[d])
        keys[d].add(k)
    width = window - SHINGLE + 1
    assert sliding_least(values, width).tolist() == [min(values[i : i + width]) for i in range(max(0, len(values) - width + 1))]
    by_words = defaultdict(set)
    for d in range(len(docs)):
        words = docs[d].split()
        held = band_keys(Sequence([docs[d].encode()], Words()), window)
        assert set(held[1].tolist()) == keys[d]  # neighbours in a batch do not matter
        for i in range(len(words) - window + 1):
            mine = band_keys(Sequence([" ".join(words[i : i + window]).encode()], Words()), window)[1].tolist()
            assert len(mine) == 1 and mine[0] in keys[d]
            by_words[tuple(words[i : i + window])].add(mine[0])
    assert all(len(v) == 1 for v in by_words.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 1))
def test_codes_are_those_of_the_words(x, y, big):
    x, y = [v + big * 10**6 for v in x], [v + big * 10**6 for v in y]
    u, v = shingle_codes(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64))
    held = [tuple(w[i : i + SHINGLE]) for w in (x, y) for i in range(len(w) - SHINGLE + 1)]
    codes = [*u.tolist(), *v.tolist()]
    assert len(codes) == len(held) and len(set(codes)) == len(set(held)) == len(set(zip(codes, held)))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(60, 200), st.integers(1, 6))
def test_passages_have_the_similarity_asked_for(seed, n, edits):
    r = random.Random(seed)
    base = prose(r, n).split()
    near = list(base)
    for at in r.sample(range(len(near)), edits):
        near[at : at + 1] = r.choice([["changed"], ["two", "words"], []])
    a, b = prose(r, 40).split() + base + prose(r, 40).split(), prose(r, 70).split() + near + prose(r, 10).split()
    x, y = numbered_words(" ".join(a).encode(), " ".join(b).encode())
    lines = [(i, i, j - i) for i in range(len(a) - 24) for j in range(len(b) - 24) if a[i : i + 24] == b[j : j + 24]]
    for p, q, c, d in common_passages(x, y, lines, 0.8, 30, 12):
        assert similarity(a[p:q], b[c:d]) >= 0.8 and q - p >= 29 and a[p : p + 5] == b[c : c + 5] and a[q - 5 : q] == b[d - 5 : d]


def test_passages_grow_over_changed_words():
    r = random.Random(2)
    for edits, n in ((1, 60), (2, 100), (3, 150), (4, 220)):
        for _ in range(30):
            base = prose(r, n).split()
            near = list(base)
            for at in r.sample(range(8, n - 8), edits):
                near[at : at + 1] = r.choice([["changed"], ["two", "words"], []])
            if similarity(base, near) < 0.83:
                continue
            a, b = prose(r, 33).split() + base + prose(r, 21).split(), prose(r, 7).split() + near + prose(r, 40).split()
            x, y = numbered_words(" ".join(a).encode(), " ".join(b).encode())
            lines = [(i, i, j - i) for i in range(len(a) - 24) for j in range(len(b) - 24) if a[i : i + 24] == b[j : j + 24]]
            assert lines
            found = common_passages(x, y, lines, 0.8, 30, 12)
            assert found == [(33, 33 + len(base), 7, 7 + len(near))]


def test_what_equals_is_found_whole(spark):
    """Every 30 words that two documents share are marked, and removed in all but the first."""
    r = random.Random(6)
    rows = []
    for i, n in enumerate([30, 31, 40, 51, 60, 120, 200] * 3):
        p = prose(r, n)
        rows += [(100 * i + j, prose(r, r.randrange(0, 90)) + " " + p + "\n" + prose(r, r.randrange(0, 90))) for j in range(4)]
        cut = p.split()[: n // 2 + 15]  # a shorter, earlier part of it, so that neighbourhoods differ
        rows.append((100 * i - 1, prose(r, 40) + " " + " ".join(cut) + " " + prose(r, 40)))
    variants = prose(r, 70).split()  # pivots that share a key but no passage with those that follow
    rows += [(9000 + i, prose(r, 30) + " " + " ".join(variants[: 26 + i % 5]) + " " + prose(r, 30)) for i in range(20)]
    marked, removed, _ = spans_of(spark, rows)
    words = {d: plain_words(t) for d, t in rows}
    places = defaultdict(list)
    for d in sorted(words):
        for k in range(len(words[d]) - LEAST + 1):
            places[tuple(words[d][k : k + LEAST])].append((d, k))
    want, gone = defaultdict(set), defaultdict(set)
    for held in places.values():
        if len({d for d, _ in held}) > 1:
            for d, k in held:
                want[d] |= set(range(k, k + LEAST))
                gone[d] |= set(range(k, k + LEAST)) if d != held[0][0] else set()
    assert want and dict(marked) == dict(want)
    assert {d: x for d, x in removed.items() if x} == {d: x for d, x in gone.items() if x}


@pytest.mark.parametrize("n,edits", [(60, 1), (100, 2), (150, 3)])
def test_recall_of_similar_passages_in_longer_lines(spark, n, edits):
    r = random.Random(n)
    rows, spots = [], {}
    for i in range(150):
        base = prose(r, n).split()
        near = list(base)
        for at in r.sample(range(n), edits):
            near[at] = "changed"
        if similarity(base, near) < 0.8:
            continue
        for j, p in enumerate((base, near)):
            a = r.randrange(0, 60)
            rows.append((2 * i + j, " ".join([prose(r, a), *p, prose(r, r.randrange(0, 60))]).strip()))
            spots[2 * i + j] = set(range(a, a + n))
    marked, removed, _ = spans_of(spark, rows)
    share = [len(marked[d] & s) / n for d, s in spots.items()]
    assert min(share) > 0.5 and np.mean(share) >= 0.97 and sum(bool(removed[d]) for d in spots) == len(spots) / 2


def corpus():
    r = random.Random(3)
    passages = [prose(r, n) for n in (51, 52, 60, 90, 140)]
    rows, planted = [], defaultdict(set)
    for i in range(120):
        text = "\n".join(prose(r, r.choice([8, 30, 70])) for _ in range(4))
        if i % 2:
            p = r.randrange(5)
            at = text.index(" ", r.randrange(len(text) // 2))
            text = text[:at] + " " + (passages[p].upper() if i % 3 else passages[p].replace(" ", "\n", 3)) + " " + text[at:]
            planted[p].add(1000 + i)
        rows.append((1000 + i, text))
    line = prose(r, 60).split()
    rows += [(2000 + i, prose(r, 30) + "\n" + " ".join(line[:20] + [f"own{i}"] + line[21:])) for i in range(4)]
    rows += [(3000, prose(r, 40) + "\n" + "repeated only here " * 12 + "\n" + "repeated only here " * 12)]
    return rows, planted


def test_passages_lines_and_clean_documents(spark):
    rows, planted = corpus()
    marked = defaultdict(list)
    for x in repeated_spans(with_clash(documents(spark, rows + ODD), "first", "key", "row", "__packed", "__salt", "window")).collect():
        marked[x.doc_id].append(x)
    flagged = {d for ids in planted.values() for d in ids} | {2000, 2001, 2002, 2003}
    assert set(marked) == flagged
    for ids in planted.values():
        for d in ids:
            assert [(x.component_id, x.removed) for x in marked[d]] == [(min(ids), d != min(ids))]
    assert {x.component_id for i in range(4) for x in marked[2000 + i]} == {2000}
    text = {x.doc_id: x.text for x in without_repeats(with_clash(documents(spark, rows), "__packed", "__cut", "row", "a.b")).collect()}
    for d, t in rows:
        assert (text[d] == t) == (d not in flagged or d in {min(i) for i in planted.values()} | {2000})


def test_hot_passages_copies_and_long_texts(spark):
    r = random.Random(8)
    shared, long = prose(r, 45), prose(r, 30_000)
    rows = [(i, f"{prose(r, 5)} {shared} {prose(r, 5)}") for i in range(600)] + [(1000 + i, prose(r, 50) if i % 3 else shared) for i in range(60)] + [(5000, long), (5001, prose(r, 40) + " " + long), (6000, "same words again " * 9000), (6001, "same words again " * 8000)]
    marked, removed, ids = spans_of(spark, rows)
    # a word beside the passage may be the same in two of them
    assert all(set(range(5, 50)) <= marked[i] and len(marked[i]) <= 47 and ids[i] == {0} and bool(removed[i]) == (i > 0) for i in range(600))
    assert all(len(marked[1000 + i]) == (0 if i % 3 else 45) for i in range(60))
    assert len(removed[5001]) == 30_000 and not removed[5000] and len(marked[5000]) == 30_000
    assert len(removed[6001]) == 24_000


def test_merging_and_cutting():
    assert merged([(5, 9, True), (0, 5, True), (8, 12, False), (20, 22, False)]) == [(0, [(0, 5, True)]), (5, [(5, 9, True), (9, 12, False)]), (20, [(20, 22, False)])]
    assert cut_words(" a b\nc  d ", [(1, 2)]) == " a  d " and cut_words("a b", [(0, 1)]) == ""


def test_odd_tables(spark):
    assert repeated_spans(documents(spark, [])).count() == 0 and repeated_spans(documents(spark, ODD)).count() == 0
    r = random.Random(5)
    t = prose(r, 90)
    same = documents(spark, [(1, t), (1, t), (None, t), (None, t + " more")])
    out = repeated_spans(same).select("doc_id", "component_id", "removed").distinct().collect()
    assert {tuple(x) for x in out} == {(1, 1, False), (None, 1, True)}
    assert without_repeats(documents(spark, ODD)).count() == len(ODD)
    assert sorted((x.doc_id or 0, x.text) for x in without_repeats(same).collect()) == [(0, ""), (0, " more"), (1, t), (1, t)]
