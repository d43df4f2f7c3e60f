import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm import test_decontaminate as decontaminate
from tests.llm import test_quality as quality
from tests.llm import test_simhash as simhash
from tests.llm.helpers import ODD, documents
from weftline.llm.mixing import mixed_documents
from weftline.llm.sharding import extendible_shards


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def corpus():
    r = random.Random(11)
    rows = [(i, prose(r, r.choice([12, 40, 120])), "en", "big" if i % 3 else "small") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "big") for i in range(10)]  # copies
    rows += [(300 + i, rows[i][1] + " tail", "en", "big") for i in range(120) if len(rows[i][1].split()) == 120][:6]  # near copies
    rows += [(400, "too short", "en", "big"), (401, "again and again and again " * 9, "en", "small"), (402, "# $ % " * 20, "en", "small")]
    items = [(i, prose(r, 14)) for i in range(5)]
    rows += [(500 + i, prose(r, 20) + " " + items[i % 5][1] + " " + prose(r, 20), "en", "small") for i in range(7)]
    return rows + [(None, prose(r, 50), None, None)] + [(*x, None, None) for x in ODD], items


def plain_kept(rows, items):
    """doc_ids after the filtering stages, by the plain forms the operators' own tests have."""

    def good(text):
        n, chars, symbols, dup, repeated = quality.plain(text)
        return n >= 10 and 100 * repeated <= 20 * n and 5 * symbols <= n

    held = [r for r in rows if good(r[1])]
    parts = simhash.plain_components([(r[0], simhash.plain_fingerprint(r[1])) for r in held])
    held = [r for r, (d, _, c) in zip(held, parts, strict=True) if d == c]
    hit = {r[0] for r in decontaminate.plain([(r[0], r[1]) for r in held], items, 10) if r[-1]}
    return {r[0] for r in held} - hit


def test_stages_against_plain_forms(spark, tmp_path):
    rows, items = corpus()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_kept(rows, items)
    assert len(want) < len(rows) - 20 and None in want
    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in C.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        names = docs.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert names == before.columns
        if name == "decontamination":
            assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want)
            mixed = Counter(r.doc_id for r in mixed_documents(docs, max_repetition=2.0).collect())
        if name == "mixing":
            assert Counter(r.doc_id for r in docs.collect()) == mixed and set(mixed) == want and max(mixed.values()) == 2
            shards = Counter((r.doc_id, r.shard) for r in extendible_shards(docs, 64 << 20).collect())
    out = Counter((r.doc_id, r.shard) for r in docs.collect())
    assert out == shards  # one shard holds them all
    assert Counter((r.doc_id, r.shard) for r in C.run(spark, str(tmp_path)).collect()) == out


def test_clashing_columns_maps_and_repeated_rows(spark, tmp_path):
    """Every column goes through every stage, whatever its name or type; of repeated rows one stays."""
    r = random.Random(12)
    rows = [(i, prose(r, 40), "en", "big" if i % 3 else "small") for i in range(40)]
    rows += [rows[0]] * 5 + [(1, prose(r, 40), "en", "big"), (None, rows[2][1], "en", "big"), (None, prose(r, 40), "en", "big"), (None, None, None, None)]
    names = ["__n", "__kept", "__id", "__deal", "__packed", "__salt", "fp", "component", "shard", "depth", "h", "n_bytes", "key", "hit", "epoch", "position", "a.b", "n_words"]
    docs = documents(spark, rows)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(rows[7][1].split()[:12])), (None, " ".join(rows[8][1].split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for name, stage in C.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard_2", "depth_2"])
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = Counter(x.doc_id for x in docs.collect())
    assert sum(counts["quality"].values()) == len(rows) - 1
    # copies of rows 0 and 2 go, also the one without an id; both texts of id 1 stay, and the other row without an id
    assert counts["near_duplicates"] == Counter([*range(40), 1, None])
    assert counts["decontamination"] == Counter([i for i in range(40) if i not in (7, 8)] + [1, None])
    assert set(counts["mixing"]) == set(counts["sharding"]) == set(counts["decontamination"])
    for x in docs.collect():
        for n in names:
            assert x[n] == f"{n}:{'none' if x.doc_id is None else x.doc_id}"
        assert x.m == {"k": x.doc_id}


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
