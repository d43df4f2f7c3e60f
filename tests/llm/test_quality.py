import itertools
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm.quality import BASE, RULES, Rule, Signals, estimate, expected_ns, keep_good, ordered, passes, quality_verdicts


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["a", "b", "\n", "É|", "  ", "x\x1c"]), max_size=60).map(" ".join)))
def test_signals_are_the_plain_ones(text):
    s = Signals(text.encode())
    assert (len(s.words), s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == plain(text)


def test_windows_are_exact_in_very_long_texts():
    words = [f"w{i * i % 39_989}" for i in range(45_000)]
    assert Signals(" ".join(words).encode()).n_repeat_words == plain(" ".join(words))[4]


@pytest.fixture(scope="module")
def docs(spark):
    good = "A fair sentence of some ten words or rather more stands here, number {}."
    return [(i, good.format(i)) for i in range(20, 40)] + [(50, "# $ " * 12), (51, " ".join(f"WORD{i}" for i in range(30))), (52, "one two three four five six " * 9)] + ODD


def test_verdicts(spark, docs):
    out = quality_verdicts(with_clash(documents(spark, docs), "kept", "n_words"))
    assert out.count() == len(docs)
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for d, text in docs:
        n = plain(text)
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n for r in by_id[d])
    assert all(r.kept and not r.base_failed for i in range(20, 40) for r in by_id[i])
    assert not any(r.kept for i in (1, 2, 3, 4, 5, 50, 51, 52) for r in by_id[i])
    assert not by_id[51][0].base_failed and by_id[52][0].base_failed


def test_order_changes_nothing_but_cost(spark, docs):
    frame = documents(spark, docs)
    assert {r["name"] for r in estimate(frame)} == {r.name for r in RULES} == {r.name for r in ordered(frame)}
    kept = {tuple(r) for r in keep_good(frame, RULES).select("doc_id", "text").collect()}
    assert kept == {tuple(r) for r in keep_good(frame, RULES[::-1]).select("doc_id", "text").collect()}
    assert {k[0] for k in kept} == {*range(20, 40)}
    assert {r["name"]: r["rejected"] for r in estimate(frame, BASE)}["few_words"] == sum(len((t or "").split()) < 10 for _, t in docs)


def test_columns_pass_and_empty_tables(spark, docs):
    frame = with_clash(documents(spark, docs), "kept")
    assert keep_good(frame).schema == frame.schema
    assert keep_good(documents(spark, [])).count() == 0 and quality_verdicts(documents(spark, [])).count() == 0


def test_the_order_saves_work(spark):
    """Rules run fewer times, and cost less by the estimates, than in any other order."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["# $ %", "word", "OTHER", "again again"]) for _ in range(r.choice([3, 200, 400])))) for i in range(300)]
    docs = documents(spark, rows)
    found = estimate(docs, RULES, 10**6)
    assert [e["rows"] for e in found] == [300] * len(RULES) and sum(e["rejected"] for e in found) > 100
    order = tuple(sorted(RULES, key=lambda x: -next(e["rejected"] / max(1, e["ns"]) for e in found if e["name"] == x.name)))
    costs = [expected_ns(found, p) for p in itertools.permutations(RULES)]
    assert expected_ns(found, order) <= min(costs) * 1.001 and max(costs) > 1.5 * min(costs)
    ran = Counter()

    def counted(rule):
        def rejects(s):
            ran[rule.name] += 1
            return rule.rejects(s)

        return Rule(rule.name, rejects)

    kept = [passes(t.encode(), tuple(map(counted, order))) for _, t in rows]
    assert sum(ran.values()) < 0.8 * len(rows) * len(RULES) and ran[order[0].name] == len(rows)
    assert kept == [passes(t.encode(), tuple(reversed(order))) for _, t in rows]
