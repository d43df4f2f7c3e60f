"""Near-duplicates by SimHash: pigeonhole blocks find close fingerprints, Hamming distance verifies them, components group them.

Nulls and texts without a word have fingerprint zero and link like any other. Rows with equal doc_id and text are rows of
their own with equal results. A null doc_id is never a component's id unless every doc_id of the component is null. Further
columns are not looked at; where documents are returned, they go along untouched.

All that is joined are fingerprints, each once: a group of copies of any size is one, and however many near copies there are,
no more than 679121 fingerprints differ from one in four bits or fewer. Rows meet their component by a join that deals out hot
fingerprints.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, hot_keys, join_hot, map_texts, materialize, packed, spread_buckets, unpacked, white_words

BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash over the hashes of all word shingles, repeats included, as a signed long."""
    words = white_words(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def block_count(rows: int, distance: int) -> int:
    """How many blocks to cut fingerprints into, for so many distinct ones.

    With b blocks, close fingerprints agree on some b - distance of them. More blocks give more keys for each fingerprint
    but fewer chance meetings; every choice finds all close pairs, so this only weighs the rows of the two.
    """

    def rows_made(b: int) -> float:
        keys = comb(b, distance)
        return keys * rows * (1 + rows / 2 / 2 ** (BITS * (b - distance) / b))

    return min(range(distance + 1, distance + 8), key=rows_made)


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks that agree."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect just the values that chains of close ones connect, at most one for each value."""
    left, links = np.unique(values), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                reached += list(left[near])
                left = left[~near]
    return links


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` of every document, written to the shared folder."""
    return materialize(map_texts(docs, ["doc_id", "text"], lambda t: (fingerprint(t, shingle),), "doc_id long, fp long"), "fingerprints")


def close_links(distinct: DataFrame, distance: int = 4, few: int = 32, chunk: int = 1 << 16) -> DataFrame:
    """``a, b``: links that connect what pairs of distinct ``fp`` at most ``distance`` bits apart connect.

    Buckets of a few fingerprints are joined with themselves. Larger ones, as large groups of near copies make, give no
    pairs: each group of at most about 2 * chunk fingerprints gives the links of a spanning forest.
    """

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    masks = block_masks(block_count(distinct.count(), distance), distance)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)))
    members = distinct.select("fp", F.explode(keys).alias("key"))
    small, large = spread_buckets(members, "key", few, chunk, F.xxhash64("fp"))
    other = small.select("key", F.col("fp").alias("fq"))
    pairs = small.join(other, "key").where((F.col("fp") < F.col("fq")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= distance))

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(group["fp"].to_numpy(), distance), columns=["a", "b"], dtype="int64")

    return pairs.select(F.col("fp").alias("a"), F.col("fq").alias("b")).union(large.groupBy("key", "__c", "__d").applyInPandas(forest, "a long, b long"))


def simhash_groups(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``fp, n, component, component_id`` for the distinct fingerprints of ``doc_id, fp``, n being the rows that have it; component
    is one of its fingerprints."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    linked = connected_components(close_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    grouped = materialize(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped")
    least = materialize(grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "least")
    whole = join_hot(grouped, least.drop("size"), ["component"], hot_keys(least, ["component"], "size"), F.col("fp"))
    out = materialize(whole.select("fp", "n", "component", "component_id"), "groups")
    for used in (distinct, grouped, least):
        discard(used)
    return out


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows, which have ``fp``, with their component; a fingerprint may have any number of rows."""
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id())
    return join_hot(rows.withColumn("__deal", spread), groups.drop("n"), ["fp"], hot_keys(groups, ["fp"], "n"), F.col("__deal")).drop("__deal")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of docs."""
    prints = fingerprints(docs, shingle)
    groups = simhash_groups(prints, distance)
    return with_groups(prints, groups).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each component, one that has its component_id; columns as they were, whatever their names and types.

    Of several such rows it is the one of the least JSON. Rows of an id that no other row has are told by the id alone; those of
    repeated ids, and without one, by their fingerprints, which are computed again.
    """
    prints = fingerprints(docs, shingle)
    groups = simhash_groups(prints, distance)
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")).alias("__id")
    stays = with_groups(prints, groups).groupBy(known)
    stays = stays.agg(F.count("*").alias("__n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("__stays"))
    stays = materialize(stays.where("__stays").drop("__stays"), "stays")  # __n: all rows of the id, whether they stay or not
    rows = packed(docs, known, F.monotonically_increasing_id().alias("__deal"))
    kept = join_hot(rows, stays, ["__id"], hot_keys(stays, ["__id"], "__n"), F.col("__deal"), hint="merge")  # one plan at every size
    once = unpacked(kept.where("__n = 1"), docs)
    if not stays.where("__n > 1").head(1):
        return once

    @F.pandas_udf("long")
    def again(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fingerprint((t or "").encode(), shingle))

    doc_id = F.col("__packed").getField("doc_id")
    repeated = kept.where("__n > 1").select("__packed", "__deal", doc_id.alias("doc_id"), again(F.col("__packed").getField("text")).alias("fp"))
    repeated = with_groups(repeated, groups).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = repeated.groupBy("component").agg(F.min_by("__packed", F.to_json("__packed")).alias("__packed"))
    return once.union(unpacked(one, docs))
