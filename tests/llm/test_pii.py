import hashlib
import random
import re

from tests.llm.helpers import ODD, documents, with_clash
from weftline.llm.pii import KINDS, luhn, personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    spans = [(m.start(), k, m.end()) for k, name in enumerate(KINDS) for m in re.finditer(BASE[name], text or "", re.A) if passes(name, m[0])]
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


CARD = "4532015112830366"
TEXTS = [
    f"é😀 write to a.b@c.de.fr, or x@y; call +1 (859) 555-5442. {CARD} 4532-0151-1283-0366 4532015112830367 at 10.0.0.256 10.0.0.25 1.2.3.4.5.6.7.8",
    "a@b.c_d@e.f+g@h.i-j@@k.l m@n..o p@q.r.", "+12345678 +123456789 +1234567890123456 +1((((2", "001.02.003.255 1.2.3 999999999999999999999.1.1.1",
    "5 5 5 5 5 5 5 5 5 5 5 5 5  5 - 5", "@" * 50, "1.1.1.1@x.y+3.4.5.6.7-8-9-0-1-2",
]


def check(spark, rows):
    out = personal_data(with_clash(documents(spark, rows), "spans", "rid", "k", "pattern", "start", "n_found")).collect()
    assert len(out) == len(rows)
    want = sorted([(repr(d), *plain(t)[:2]) for d, t in rows], key=repr)
    got = sorted([(repr(r.doc_id), [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in out], key=repr)
    assert got == want
    assert all(hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256 for r in out if r.n_found == 0)


def test_base_as_plain_expressions(spark):
    r = random.Random(1)
    parts = ["a", "B9", "@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "300", CARD, "%", "_", "\n", "é", "😀", "ab@cd.ef", "+49 30 1234567", "1.2.3.4"]
    rows = list(enumerate(TEXTS, start=50)) + [(100 + i, "".join(r.choices(parts, k=30))) for i in range(1500)]
    check(spark, rows + ODD)


def test_very_long_runs(spark):
    check(spark, [(1, "9" * 9_000), (2, "a" * 9_000), (3, "a@" + "b." * 60_000 + "c"), (4, "1." * 9_000 + "1"), (5, "+1" + "(" * 100_000), (6, "7 " * 60_000), (7, "+1 2" * 30_000)])


def test_luhn(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    numbers = ["".join(r.choices("0123456789", k=n)) for n in range(12, 20) for _ in range(40)]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", luhn(F.col("n")).alias("ok")).collect()
    assert all(x.ok == passes("card", x.n) for x in got)


def story():
    r = random.Random(3)
    rows = []
    for i in range(30):
        rows.append((i, f"Please dial number: +1 859 555 {1000 + i} today, said the {200 + i}.1.1.{i} man"))
        rows.append((100 + i, f"Send mail to address: u{i}@host{i}.com now, and the u{i}x@host.org one"))
    rows += [(200 + i, f"Please dial number: 859-555-{2000 + i} today") for i in range(5)]
    rows += [(210, "Send mail to address: root@localhost now"), (211, "the 859-555-3000 item and the tom@home house"), (212, "to address: 555-123-4567 go")]
    rows += [(300 + i, "the man and the house and the dog by the sea") for i in range(60)]
    r.shuffle(rows)
    return rows


def test_contexts_find_what_the_base_does_not(spark):
    rows = story()
    out = {r.doc_id: r for r in personal_data(documents(spark, rows)).collect()}
    text = dict(rows)
    for i in range(200, 205):
        a = text[i].index("859")
        assert out[i].spans == f"phone:{a}:{a + 12}" and out[i].n_found == 1 and out[i].n_phone == 0 and out[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[210].spans == "email:22:36"
    assert out[211].spans == "" and out[212].spans == ""  # a common word before, a shape that does not fit
    assert sum(r.n_found for r in out.values()) == 6
    assert {d: [r.n_email, r.n_ip, r.n_card, r.n_phone] for d, r in out.items()} == {d: plain(t)[0] for d, t in rows}


def chain():
    """Secrets and phones that only contexts of the turn before lead to."""
    r = random.Random(4)

    def key(n):
        return "".join(r.choice("abcdef0123456789") for _ in range(n - 2)) + "a1"

    rows = [(i, f'then token = "{key(40)}" it says {i} times') for i in range(100)]  # seeds: a token in quotes
    bare = [key(20) for _ in range(20)]
    rows += [(100 + i, f"then token = {k} it") for i, k in enumerate(bare)]  # found by the words before
    rows += [(200 + i, f"logged in with cookie {k} twice") for i, k in enumerate(bare)]  # the same ones in another context
    rows += [(300 + i, f"logged in with cookie {key(12)} twice") for i in range(3)]  # found by that context, which no seed has
    rows += [(400 + i, f"version {key(12)} of the file") for i in range(9)]  # in no such context
    rows += [(500 + i, "it says that the file is in the file twice, then it says so") for i in range(150)]
    return rows


def test_later_turns_find_by_contexts_that_no_seed_has(spark):
    docs = documents(spark, chain())

    def found(turns):
        return {r.doc_id for r in personal_data(docs, turns=turns).where("n_secret > 0").collect()}

    first = set(range(120))
    assert found(1) == first
    assert found(8) == first | set(range(200, 220)) | set(range(300, 303))
    out = {r.doc_id: r for r in personal_data(docs).collect()}
    assert out[0].spans == "secret:14:54" and out[0].n_found == out[0].n_secret == out[0].n_spans == 1 and out[400].spans == ""
    assert out[300].spans == "secret:22:34" and out[200].spans == "secret:22:42"


def test_discovery_on_planted_contexts(spark):
    """Recall and precision of what the base leaves, in text with as many decoys."""
    r = random.Random(5)
    words = "the of and to in that it was for on with as his they be at one have this from".split()

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    lead = {"phone": "phone no.", "email": "reply to:", "ip": "host address"}
    good = {"phone": lambda: f"+1 859 555 {r.randrange(1000, 9999)}", "email": lambda: f"u{r.randrange(9999)}@h{r.randrange(999)}.org", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4))}
    odd = {"phone": lambda: f"859-555-{r.randrange(1000, 9999)}", "email": lambda: f"u{r.randrange(9999)}@localhost", "ip": lambda: ".".join(str(r.randrange(300, 999)) for _ in range(4))}
    rows, want = [], set()
    for i in range(600):
        kind = r.choice(list(lead))
        planted = r.random() < 0.12
        rows.append((i, f"{prose(8)} {lead[kind]} {(odd if planted else good)[kind]()} {prose(8)} {odd[kind]() if i % 3 == 0 else ''} {prose(4)}"))
        want |= {i} if planted else set()
    got = {x.doc_id: x.n_found for x in personal_data(documents(spark, rows)).collect()}
    hits = sum(got[i] > 0 for i in want)
    assert hits >= 0.95 * len(want) and sum(got.values()) - hits <= 0.05 * hits


def test_too_few_seeds_find_nothing(spark):
    rows = [x for x in story() if x[0] not in range(4, 30)]
    out = personal_data(documents(spark, rows)).where("doc_id between 200 and 204")
    assert out.where("n_found > 0").count() == 0


def test_no_python_in_the_plan_and_empty_tables(spark):
    out = personal_data(documents(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in personal_data(docs).collect()}
    for r in docs.collect():
        counts, digest, _ = plain(r.text)
        got = out[r.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == counts and got.base_sha256 == digest
