"""Extendible hashing: a directory of hash prefixes, in which only buckets over the byte limit split on another bit.

The hash of a row has 32 bits of the md5 of its doc_id, then 28 bits of the md5 of its text, so rows of one doc_id, or of
none, split too. Rows that agree in all bits are overflow: they are numbered and dealt to pages of their bucket, each within the
limit. A text over the limit has a page of its own, the only one that may be over. A null text has 0 bytes. Further columns
are not looked at, whatever their names; where documents are returned, they go along untouched.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize, packed, small_enough, unpacked

BITS = 60
STEP = 8


def _md5_bits(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def row_hash(copy: Column | None = None) -> Column:
    """The hash; with a number of the row's copy, copies of a document have hashes of their own."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    high = _md5_bits(name if copy is None else F.concat_ws(":", name, copy.cast("string")), 8)
    return F.shiftleft(high, 28) + _md5_bits(F.coalesce("text", F.lit("")), 7)


def row_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def row_sizes(docs: DataFrame, copy: Column | None = None) -> DataFrame:
    """``doc_id, h, n_bytes``; written to the shared folder."""
    return materialize(docs.select("doc_id", row_hash(copy).alias("h"), row_bytes().alias("n_bytes")), "sizes")


def _lookup(rows: DataFrame, level: DataFrame) -> DataFrame:
    """rows, which have ``prefix``, with what a level says of it. Prefixes are even but for rows that agree in all bits; a level
    counts the rows of each, and hot ones are dealt out. A level is broadcast if it is small, counted first."""
    if small_enough(level, 50_000):
        return rows.join(F.broadcast(level.drop("n")), "prefix")
    return join_hot(rows, level.drop("n"), ["prefix"], hot_keys(level, ["prefix"], "n"), F.monotonically_increasing_id())


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Levels of the directory as (bits, table of ``prefix, n, depth, shard_bytes``) for hash prefixes of so many bits.

    depth is the number of bits of the bucket that the prefix is in, or null where the next level decides. Each level sums
    bytes by prefix once and by all shorter prefixes from those sums; the first has 16 prefixes for each bucket there must be,
    further ones, 8 bits longer, hold only what is still over the limit.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    low, bits, levels = 0, min(BITS, max(4, ceil(log2(max(1, total / limit))) + 4)), []
    rows = sizes
    while True:
        sums = rows.groupBy(F.shiftright("h", BITS - bits).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        sums = materialize(sums, "prefixes")
        deep = sums.select("prefix", "bytes", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        short = F.shiftright("prefix", 1).alias("short") if bits == low else F.expr(f"shiftright(prefix, {bits} - depth)").alias("short")
        deep = deep.select("prefix", "bytes", "depth", short)
        held = deep.groupBy("depth", "short").agg(F.sum("bytes").alias("shard_bytes")).where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        found = deep.drop("bytes").join(held, ["depth", "short"]).groupBy("prefix").agg(F.min_by(F.struct("depth", "shard_bytes"), "depth").alias("at"))
        level = materialize(sums.select("prefix", "n").join(found, "prefix", "left").select("prefix", "n", "at.depth", "at.shard_bytes"), "level")
        levels.append((bits, level))
        if bits == BITS or not level.where("depth is null").head(1):
            return levels
        rows = _lookup(rows.withColumn("prefix", F.shiftright("h", BITS - bits)), level.where("depth is null").select("prefix", "n")).drop("prefix")
        low, bits = bits, min(BITS, bits + STEP)


def _assign(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows, which have h, with ``depth`` and ``shard_bytes``."""
    done, left = None, rows
    for bits, level in levels:
        here = _lookup(left.withColumn("prefix", F.shiftright("h", BITS - bits)), level).drop("prefix")
        settled = here.where("depth is not null")
        done = settled if done is None else done.union(settled)
        if level is levels[-1][1]:
            return done
        left = here.where("depth is null").drop("depth", "shard_bytes")


def _bits() -> Column:
    return F.concat(F.lit("b"), F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth")))


def _paged(rows: DataFrame, levels: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """rows of _assign() with ``shard``; overflow, written out once for that, is numbered by its partitions and their row counts."""
    rows = rows.withColumn("shard", _bits())
    last = levels[-1][1].where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit))
    if levels[-1][0] < BITS or not last.head(1):
        return rows
    over = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    held = materialize(rows.where(over).withColumn("__tile", F.spark_partition_id()), "overflow")
    counts = held.groupBy("h", "__tile").agg(F.count("*").alias("n"), F.max("n_bytes").alias("size"))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("__tile")) - F.col("n")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("size").over(Window.partitionBy("h")))))
    number = F.row_number().over(Window.partitionBy("h", "__tile").orderBy("n_bytes")) - 1
    paged = held.join(counts.select("h", "__tile", before.alias("__first"), each.alias("__each")), ["h", "__tile"])
    paged = paged.withColumn("shard", F.concat("shard", F.lit("."), F.floor((F.col("__first") + number) / F.col("__each")).cast("string")))
    return rows.where(~over).select(*rows.columns).union(paged.select(*rows.columns))


def extendible_shards(docs: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes``: a row for each row of docs. shard is b and the bits of its bucket, and
    for overflow a dot and the number of the page; shard_bytes are those of the whole bucket."""
    sizes = row_sizes(docs)
    levels = directory(sizes, limit)
    return _paged(_assign(sizes, levels), levels, limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or the first of name_2, name_3 .. that docs has no column of."""
    taken, found, i = {c.lower() for c in docs.columns}, name, 1
    while found in taken:
        i += 1
        found = f"{name}_{i}"
    return found


def sharded_documents(docs: DataFrame, limit: int = 64 << 20, spread_copies: bool = False) -> DataFrame:
    """docs with ``shard`` and ``depth`` as their last columns; if docs has such columns, they stay, and the new ones are shard_2 or the like.

    With ``spread_copies`` the number of the file and of the partition a row is read from go into its hash, so that a document's
    repeats, which a mix puts far apart, do not meet in one shard again.
    """
    number = F.regexp_extract(F.input_file_name(), r"part-([0-9]+)", 1)
    copy = F.concat_ws(".", number, F.spark_partition_id().cast("string")) if spread_copies else None
    rows = materialize(packed(docs, "doc_id", row_hash(copy).alias("h"), row_bytes().alias("n_bytes")), "rows") if spread_copies else packed(docs, row_hash().alias("h"), row_bytes().alias("n_bytes"))
    levels = directory(rows.select("h", "n_bytes") if spread_copies else row_sizes(docs), limit)
    out = _paged(_assign(rows, levels), levels, limit)
    return unpacked(out, docs, {free_name(docs, "shard"): F.col("shard"), free_name(docs, "depth"): F.col("depth")})


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20) -> None:
    """Parquet files of docs, a folder for each shard; every shard is gathered in one task, which its byte limit bounds."""
    shard = free_name(docs, "shard")
    sharded_documents(docs, limit).repartition(shard).write.partitionBy(shard).parquet(path)
