"""Personal data: seed entities by pattern, then bootstrapped contextual extraction. DataFrame functions only.

Seeds are the base matches of e-mail and IP addresses, card and phone numbers, and, as a kind of the method's own, secrets: long
keys in quotes that a name is set to. The words on both sides of a seed induce lexical patterns: the last one to three words
before it, the first one or two after it. Identifier-like strings that are no seed, as an address without a dot, a number without its
plus sign or a code of letters and digits, are candidates.

Patterns and instances form a graph that is scored in turns. A pattern's score for a kind is the believed share of its distinct
instances; it takes a least number of believed ones and a least score, and patterns that ordinary words follow more often than
identifiers do are none. A candidate's belief comes from the patterns of its places that suit its shape. Candidates that are
believed count as instances from the next turn on, so that their other contexts become patterns too, until a turn adds nothing.

Texts are whole; null is empty. Places are code points from 0, ends exclusive. The regular expressions here match what the
plain base expressions match, without recursion or rescanning, so that very long texts are no harder than others. Repeated
rows are found alike, each once, and count once as instances; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, small_enough

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's own seeds: keys of letters and digits in quotes behind a name and = or :.
SECRETS = {"secret": r"""(?<=[A-Za-z0-9_]\x20{0,3}[=:]\x20{0,3}["'])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+={0,2}+(?=["'])"""}
CANDIDATES = {
    "address": r"(?<![^\s@])[^\s@]++@[^\s@,;]++",
    "number": r"(?<![0-9A-Za-z])[(+]?[0-9]++(?:[\x20().:-]{1,2}[0-9]++)*+(?![0-9A-Za-z])",
    "code": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+",
}
ADDRESS, NUMBER, CODE = range(len(ALL), len(ALL) + 3)
#: What is looked for before the costlier expressions are.
NEEDS = {
    "email": "@", "address": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "number": r"[0-9][^A-Za-z]{5}",
    "secret": r"""[=:]\x20{0,3}["'][A-Za-z0-9+/_-]{24}""", "code": "[0-9][A-Za-z_-]|[A-Za-z_-][0-9]",
}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TAIL = 80
#: A word of a context: a run of letters and digits, or any other character but quotes.
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}\"'`\x{201C}\x{201D}\x{2018}\x{2019}]"
#: Up to so many patterns are looked for as a set in the scan of the texts; more are joined.
FEW_PATTERNS = 2_000
HIT = "k:int,i:int,gap:int,tail:string,match:string,head:string"


def _hits(number: int, expression: str, need: str) -> Column:
    """Matches of an expression with the length and the end of the text before each, from the one before on, and the beginning of the
    text after it, up to the next one."""
    text = F.col("text")
    pieces = F.split(text, expression, -1)
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    before = F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.struct(F.length(p).alias("gap"), F.substring(p, -TAIL, TAIL).alias("tail")))
    after = F.transform(F.slice(pieces, F.lit(2), F.size(found)), lambda p: F.substring(p, 1, TAIL))
    zipped = F.zip_with(before, found, lambda b, m: F.struct(b["gap"].alias("gap"), b["tail"].alias("tail"), m.alias("match")))
    zipped = F.zip_with(zipped, after, lambda z, h: F.struct(z["gap"].alias("gap"), z["tail"].alias("tail"), z["match"].alias("match"), h.alias("head")))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(number).alias("k"), i.alias("i"), z["gap"].alias("gap"), z["tail"].alias("tail"), z["match"].alias("match"), z["head"].alias("head")))
    there = F.contains(text, F.lit(need)) if need == "@" else F.rlike(text, F.lit(need))
    return F.when(there, rows).otherwise(F.array().cast(f"array<struct<{HIT}>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (d.cast("int") * (1 + i % 2)))
    total = F.aggregate(F.transform(doubled, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid() -> Column:
    m, n = F.col("match"), F.length(_digits(F.col("match")))
    ip = F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    card = F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return F.when(F.col("k") == 0, True).when(F.col("k") == 1, ip).when(F.col("k") == 2, card).when(F.col("k") == 3, n.between(9, 15)).when(F.col("k") == 4, True)


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, rid`` of every row, and ``rid, k, start, end, match, tail, head`` of all matches; k numbers ALL, then CANDIDATES."""
    expressions = [*BASE.items(), *SECRETS.items(), *CANDIDATES.items()]
    hits = F.concat(*(_hits(k, e, NEEDS[name]) for k, (name, e) in enumerate(expressions)))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = materialize(plain.select("doc_id", F.monotonically_increasing_id().alias("rid"), hits.alias("hits")), "matches")
    each = table.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    upto = Window.partitionBy("rid", "k").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    placed = materialize(placed.select("rid", "k", "start", "end", "match", "tail", "head").where(_valid().isNull() | _valid()), "placed")
    return table.select("doc_id", "rid"), placed


def _apart(spans: DataFrame) -> DataFrame:
    """Seeds, and the candidates that overlap none of their row. A secret may hold a base match; both stay."""
    seed = F.col("k") < len(ALL)
    upto = Window.partitionBy("rid").rowsBetween(Window.unboundedPreceding, 0)  # growing frames, both; a shrinking one is quadratic
    before = F.max(F.when(seed, F.col("end"))).over(upto.orderBy("start", "k"))
    after = F.min(F.when(seed, F.col("start"))).over(upto.orderBy(F.desc("start"), F.desc("k")))
    held = spans.withColumn("__before", before).withColumn("__after", after)
    clear = (F.coalesce("__before", F.lit(0)) <= F.col("start")) & (F.col("__after").isNull() | (F.col("__after") >= F.col("end")))
    return held.where(seed | clear).drop("__before", "__after")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _grams(docs: DataFrame) -> DataFrame:
    """``grams``: all one to three neighbouring words of each text, a projection for each step so that none is done twice."""
    out = docs.where("text is not null").select(_words(F.col("text")).alias("one")).where(F.size("one") > 0)
    none = F.array().cast("array<string>")
    for name, before, k in (("two", "one", 2), ("three", "two", 3)):
        joined = F.zip_with(F.slice(before, F.lit(1), F.size("one") - (k - 1)), F.slice("one", F.lit(k), F.size("one")), lambda a, b: F.concat_ws(" ", a, b))
        out = out.withColumn(name, F.when(F.size("one") >= k, joined).otherwise(none))
    return out.select(F.concat("one", "two", "three").alias("grams"))


def _contexts(spans: DataFrame) -> DataFrame:
    """spans once for each pattern they stand in: a side, and the words there."""
    before, after = F.col("__before"), F.col("__after")
    sides = [*(F.when(F.size(before) >= k, F.concat(F.lit("<"), F.concat_ws(" ", F.slice(before, -k, k)))) for k in (1, 2, 3))]
    sides += [F.when(F.size(after) >= k, F.concat(F.lit(">"), F.concat_ws(" ", F.slice(after, 1, k)))) for k in (1, 2)]
    found = F.filter(F.array(*sides), lambda p: p.isNotNull())
    held = spans.withColumn("__before", _words(F.col("tail"))).withColumn("__after", _words(F.col("head")))
    return held.withColumn("pattern", F.explode(found)).drop("tail", "head", "__before", "__after")


def _fits(kind: Column) -> Column:
    """Whether a candidate's shape suits a kind."""
    n, k = F.length(_digits(F.col("match"))), F.col("k")
    ip = F.rlike("match", F.lit(r"^[0-9]+(?:[.:][0-9]+){3,7}$"))
    number = F.when(kind == 1, ip).when(kind == 2, n.between(12, 19)).when(kind == 3, n.between(7, 15)).otherwise(False)
    return F.when(k == ADDRESS, kind == 0).when(k == NUMBER, number).when(k == CODE, kind == 4).otherwise(False)


def _followed(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, times``: how often the words of each gram stand in the texts, whatever is around them."""
    if small_enough(grams, FEW_PATTERNS):
        known = [r.gram for r in grams.collect()]
        each = _grams(docs).select(F.explode(F.filter("grams", lambda g: g.isin(known))).alias("gram"))
    else:
        each = join_checked(_grams(docs).select(F.explode("grams").alias("gram")), grams, ["gram"], salt_by=F.rand(3))
    return each.groupBy("gram").agg(F.count("*").alias("times"))


def patterns_graph(docs: DataFrame, spans: DataFrame, confidence: float, seeds: int) -> tuple[DataFrame, DataFrame]:
    """``pattern, n, match, k`` of the patterns that can matter, n being their distinct instances, and the candidates' places
    ``rid, k, start, end, match, pattern`` in them.

    Those have enough instances, could reach the confidence for some kind if every candidate of its shape were believed, and
    stand beside identifiers at least as often as beside other words.
    """
    places = materialize(_contexts(spans), "contexts")
    each = places.groupBy("pattern", "match", "k").agg(F.count("*").alias("named"))
    could = [F.count_if((F.col("k") == k) | _fits(F.lit(k))).alias(f"could_{k}") for k in range(len(ALL))]
    sizes = each.groupBy("pattern").agg(F.sum("named").alias("named"), F.count("*").alias("n"), *could)
    most = F.greatest(*(F.col(f"could_{k}") for k in range(len(ALL))))
    sizes = sizes.where((F.col("n") >= seeds) & (most / (F.col("n") + 1) >= confidence))
    sizes = materialize(sizes.select("pattern", "named", "n", F.expr("substring(pattern, 2)").alias("gram")), "sizes")
    times = _followed(docs, sizes.select("gram").distinct())
    good = sizes.join(times, "gram", "left").where(F.coalesce("times", F.lit(0)) <= 2 * F.col("named")).select("pattern", "n")
    places = materialize(join_checked(places, materialize(good, "patterns"), ["pattern"], salt_by=F.col("match")), "places")
    return places.select("pattern", "n", "match", "k").distinct(), places.where(F.col("k") >= len(ALL)).drop("n")


def discoveries(docs: DataFrame, spans: DataFrame, confidence: float = 0.8, seeds: int = 5, turns: int = 8) -> DataFrame:
    """``rid, k, start, end``: candidates that confident patterns find, k being the kind. spans: those of _apart().

    confidence: least score of a pattern and least belief of an instance; seeds: least number of believed instances of a
    pattern; turns: at most so many, should nothing settle before.
    """
    graph, places = patterns_graph(docs, spans, confidence, seeds)
    graph = materialize(graph, "graph")
    sure = graph.where(F.col("k") < len(ALL)).select("match", F.col("k").alias("kind")).distinct()
    free = graph.where(F.col("k") >= len(ALL))
    known, found, good = sure.withColumn("belief", F.lit(1.0)), None, None
    before = -1
    for _ in range(turns):
        scored = graph.select("pattern", "n", "match").distinct().join(known, "match").groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.count("*").alias("support"), F.sum("belief").alias("gained"))
        scored = scored.withColumn("score", F.col("gained") / (F.col("n") + 1)).where((F.col("support") >= seeds) & (F.col("score") >= confidence))
        good = materialize(scored.select("pattern", "kind", "score"), "scores")
        doubt = free.join(good, "pattern").where(_fits(F.col("kind"))).groupBy("match", "kind").agg(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))).alias("doubt"))
        found = materialize(doubt.select("match", "kind", (1 - F.exp("doubt")).alias("belief")).where(F.col("belief") >= confidence).join(sure, ["match", "kind"], "left_anti"), "belief")
        now = found.count()
        if now == before:
            break
        known, before = sure.withColumn("belief", F.lit(1.0)).unionByName(found), now
    out = places.join(good, "pattern").join(found.select("match", "kind"), ["match", "kind"]).where(_fits(F.col("kind")))
    return out.select("rid", F.col("kind").alias("k"), "start", "end").distinct()


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = F.array(*map(F.lit, ALL))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def personal_spans(docs: DataFrame, confidence: float = 0.8, seeds: int = 5, turns: int = 8) -> tuple[DataFrame, DataFrame]:
    """``doc_id, rid`` of every row of docs, and all its spans ``rid, k, start, end, base``; k numbers ALL."""
    rows, spans = occurrences(docs)
    spans = materialize(_apart(spans), "apart")
    found = discoveries(docs, spans, confidence, seeds, turns)
    every = spans.where(F.col("k") < len(ALL)).select("rid", "k", "start", "end", (F.col("k") < len(KINDS)).alias("base"))
    return rows, every.union(found.select("rid", "k", "start", "end", F.lit(False)).join(every.select("rid", "k", "start", "end"), ["rid", "k", "start", "end"], "left_anti").select("rid", "k", "start", "end", F.lit(False)))


def personal_data(docs: DataFrame, confidence: float = 0.8, seeds: int = 5, turns: int = 8) -> DataFrame:
    """``doc_id``, counts and hash of the base spans, and all ``spans``, their number ``n_spans`` and that of those the method added,
    ``n_found``, of which ``n_secret`` are secrets, for every row."""
    rows, every = personal_spans(docs, confidence, seeds, turns)
    span = F.struct("start", "k", "end")
    counts = [F.count_if(F.col("base") & (F.col("k") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    counts += [F.count_if(~F.col("base")).alias("n_found"), F.count_if(F.col("k") == len(KINDS)).alias("n_secret"), F.count("*").alias("n_spans")]
    by_row = every.groupBy("rid").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(span).alias("all"))
    held = rows.join(by_row, "rid", "left")
    empty = F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long").alias(name)

    spans = F.sha2(_joined(F.coalesce("base", empty)), 256).alias("base_sha256"), _joined(F.coalesce("all", empty)).alias("spans")
    return held.select("doc_id", *(number(f"n_{name}") for name in KINDS), *spans, number("n_found"), number("n_secret"), number("n_spans"))
