"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised. Alpha is found by bisection: the smallest, so the
flattest mix, that keeps within the repetition limit and, if one is given, does not exceed the target entropy. An entropy below that
of the shares themselves takes an alpha above 1, which favours large sources. What no alpha can meet is an error: an entropy below the
logarithm of the number of sources that tie as the largest, or one that takes more repetition than the limit.
The token budget is by default the least that passes over every source at least once, so no document is lost; a source's
passes are then weight * budget / tokens. Whole passes take every document; the last, broken one takes whole blocks of the
source in permuted order while they fit, then documents of the next block in permuted order while they fit.

A null source is a source of its own. A source without tokens has weight 0 and is passed once. Rows with equal doc_id and text
stay together. Tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text has none. Further columns are not looked at, whatever their
names; where documents are returned, they go along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_checked, materialize, packed, small_enough, unpacked

#: A source has at most so many blocks; so has a window over them, and a block at most that share of its source.
MOST_BLOCKS = 1 << 16
#: The greatest alpha that is tried; shares to that power are all but the largest source.
WIDEST = 1 << 20


def n_tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def token_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` and ``h``, which deals documents to blocks; written to the shared folder."""
    return materialize(docs.select("doc_id", "source", n_tokens("text").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("h")), "tokens")


def bisect(measure: Callable[[float], float], most: float, steps: int = 60, widest: float = 1.0) -> float:
    """The smallest alpha at which a measure that falls with alpha is at most ``most``; an error if there is none up to ``widest``."""
    if measure(0.0) <= most:
        return 0.0
    low, high = 0.0, 1.0
    while measure(high) > most * (1 + 1e-12):
        low, high = high, high * 2
        if high > widest:
            raise ValueError(f"no mix comes down to {most}")
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if measure(middle) <= most else (middle, high)
    return high


def repetition(alpha: float, tokens: np.ndarray) -> float:
    """Passes over the most repeated source when the least repeated one is passed once."""
    per_token = (tokens / tokens.sum()) ** (alpha - 1)
    return float(per_token.max() / per_token.min())


def entropy(alpha: float, tokens: np.ndarray) -> float:
    """In nats, of the weights."""
    w = (tokens / tokens.max()) ** alpha
    w = w[w > 0] / w.sum()
    return float(-(w * np.log(w)).sum())


def _spark_measures(sources: DataFrame, total: float) -> tuple[Callable[[float], float], Callable[[float], float]]:
    """The same over a table of sources that the driver should not hold: an aggregate for each step."""
    p = F.col("tokens") / F.lit(float(total))
    most = float(sources.agg(F.max("tokens")).first()[0] or 1)

    def spread(alpha: float) -> float:
        r = sources.agg(F.max(F.pow(p, F.lit(alpha - 1))).alias("a"), F.min(F.pow(p, F.lit(alpha - 1))).alias("b")).first()
        return r.a / r.b

    def bits(alpha: float) -> float:
        w = F.pow(F.col("tokens") / F.lit(most), F.lit(float(alpha)))
        r = sources.agg(F.sum(w).alias("z"), F.sum(F.when(w > 0, w * F.log(w))).alias("e")).first()
        return float(np.log(r.z) - r.e / r.z)

    return spread, bits


def find_alpha(sources: DataFrame, max_repetition: float | None, target_entropy: float | None, most_rows: int = 100_000) -> float:
    """sources: ``tokens`` of each source, all above 0. The driver holds them if they are few, which is counted first."""
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    if small_enough(sources, most_rows):
        held = np.array(sorted(r.tokens for r in sources.select("tokens").collect()), dtype=float)
        spread, bits = (lambda a: repetition(a, held)), (lambda a: entropy(a, held))
    else:
        spread, bits = _spark_measures(sources, total)
    found = [0.0]
    if max_repetition is not None:
        found.append(bisect(spread, max_repetition))
    if target_entropy is not None:
        found.append(bisect(bits, target_entropy, widest=float(WIDEST)))
    alpha = max(found)
    if max_repetition is not None and spread(alpha) > max_repetition * (1 + 1e-9):
        raise ValueError(f"an entropy of {target_entropy} takes more than {max_repetition} repetitions")
    return alpha


def _chance(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mixing_plan(sizes: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per source: weight, passes, number of blocks, whole passes, and where the broken pass ends.

    ``edge``, ``edge_block``: priority and number of the block in which it ends; ``cut``: the last document hash it takes there.
    """
    sources = materialize(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    real = sources.where("tokens > 0")
    alpha = find_alpha(real, max_repetition, target_entropy)
    total = real.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(total))
    raw = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha))).otherwise(0.0)
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    weight = raw / F.lit(float(z))
    least = real.agg(F.min(F.pow(share, F.lit(alpha - 1)))).first()[0] or 1.0
    whole = float(budget) if budget is not None else total * z / least
    passes = F.when(F.col("tokens") > 0, weight * F.lit(whole) / F.col("tokens")).otherwise(1.0)
    # a pass that differs from a whole number by rounding only counts as whole
    rounded = F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes)
    plan = sources.select("source", "tokens", weight.alias("weight"), rounded.alias("passes"))
    plan = plan.withColumn("full", F.floor("passes").cast("int")).withColumn("rest", F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / block_tokens))).cast("int"))
    plan = materialize(plan, "plan")

    key = plan.select(F.col("source").alias("__source"), "full", "rest", "blocks").where("rest > 0")
    dealt = _with_plan(sizes.where("n_tokens > 0"), key, "inner").select("source", "n_tokens", "h", "full", "rest", _block().alias("block"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("u", _priority())
    order = Window.partitionBy("source").orderBy("u", "block")
    blocks = blocks.withColumn("before", F.sum("size").over(order) - F.col("size"))
    edges = blocks.where("before <= rest and before + size > rest").select(F.col("source").alias("__source"), F.col("block").alias("edge_block"), F.col("u").alias("edge"), (F.col("rest") - F.col("before")).alias("room"))
    edges = materialize(edges, "edges")

    inside = _with_plan(dealt.select("source", "n_tokens", "h", "block", "full"), edges, "inner").where("block = edge_block")
    groups = inside.groupBy("source", _draw().alias("v")).agg(F.sum("n_tokens").alias("size"), F.first("room").alias("room"))
    groups = groups.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("v")))
    cuts = groups.where("upto <= room").groupBy("source").agg(F.max("v").alias("cut")).withColumnRenamed("source", "__source")
    edges = edges.select("__source", "edge_block", "edge")
    out = plan.join(edges, plan["source"].eqNullSafe(edges["__source"]), "left").drop("__source")
    return materialize(out.join(cuts, out["source"].eqNullSafe(cuts["__source"]), "left").drop("__source"), "mix")


def _block() -> Column:
    return F.pmod(_chance(F.lit("block"), F.col("h")), F.col("blocks")).cast("int")


def _priority() -> Column:
    return _chance(F.lit("order"), F.col("full"), F.col("source"), F.col("block"))


def _draw() -> Column:
    return _chance(F.lit("draw"), F.col("full"), F.col("h"))


def _with_plan(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what the plan has for their source, null sources included; a source may hold a third of the rows."""
    left = rows.withColumn("__known", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    right = plan.withColumn("__known", F.struct(F.col("__source").isNull(), F.coalesce("__source", F.lit("")))).drop("__source")
    return join_checked(left, right, ["__known"], how, salt_by=F.col("h")).drop("__known")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows, which have source and h, once for each epoch that takes them: ``epoch, block, position``.

    Sorted by ``position``, the epochs of each source follow each other, blocks in permuted order, and sources interleave by weight.
    """
    held = _with_plan(rows, plan.select(F.col("source").alias("__source"), "passes", "full", "blocks", "edge", "edge_block", "cut"))
    held = held.withColumn("block", _block()).withColumn("__u", _priority())
    before = (F.col("__u") < F.col("edge")) | ((F.col("__u") == F.col("edge")) & (F.col("block") < F.col("edge_block")))
    broken = before | ((F.col("block") == F.col("edge_block")) & (_draw() <= F.col("cut")))
    times = F.col("full") + F.when(broken, 1).otherwise(0)
    held = held.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    u = _chance(F.lit("order"), F.col("epoch"), F.col("source"), F.col("block"))
    at = (u.cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    return held.withColumn("position", (F.col("epoch") + at) / F.col("passes"))


def temperature_mix(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """``doc_id, source, n_tokens, weight, epoch, block, position``: a row for each time the mix takes a row of docs."""
    sizes = token_sizes(docs)
    plan = mixing_plan(sizes, max_repetition, target_entropy, budget, block_tokens)
    taken = _taken(sizes, plan)
    weights = plan.select(F.col("source").alias("__source"), "weight")
    return _with_plan(taken, weights).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")


def mixed_documents(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns, in the order of the mix: partitions by ``position``,
    sorted within, and a block's documents in permuted order. Written out and read again by file, that order stays."""
    sizes = token_sizes(docs)
    plan = mixing_plan(sizes, max_repetition, target_entropy, budget, block_tokens)
    discard(sizes)
    whole = packed(docs, "source", F.xxhash64("doc_id", "text").alias("h"))
    taken = _taken(whole, plan).withColumn("__draw", _chance(F.lit("place"), F.col("epoch"), F.col("h")))
    return unpacked(taken.repartitionByRange("position", "__draw").sortWithinPartitions("position", "__draw"), docs)
