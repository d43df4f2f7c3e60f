"""What the corpus operators share: tables, shared scratch space, words, hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\r\x0b\x0c"
#: Every byte that cannot be part of an alphanumeric word becomes a space; A-Z become a-z; bytes of non-ASCII characters stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Text handed to numpy or to a suffix array at once, so that one Arrow batch of very long texts stays bounded.
CHUNK_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(ALNUM).split()


def white_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() breaks at just these six characters."""
    return text.split()


# ---------------------------------------------------------------- shared scratch space


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if (app := spark.sparkContext.applicationId) not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
        found = _LOCAL[app]
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """Where this application's tables go; clear_scratch() removes them all once no result of an operator is needed any more."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    _delete(spark, scratch(spark))


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._weftline_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        _delete(df.sparkSession, path)


# ---------------------------------------------------------------- texts in Arrow batches


def arrow_schema(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([(n, kind(k)) for n, k in (field.split() for field in spec.split(", "))])


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a string column, null as empty; no decoding."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in column]) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, columns: list[str], row: Callable[[bytes], tuple], spec: str) -> DataFrame:
    """One output row per input row: its ``columns`` but the last, which holds the text, then what ``row`` makes of the text.

    ``spec`` is the schema of the whole output row, as ``name type, name type``.
    """
    schema = arrow_schema(spec)
    keep, text = columns[:-1], columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(t) for t in texts(batch, text)]
            rest = list(zip(*made, strict=True)) if made else [[] for _ in schema.names[len(keep) :]]
            arrays = [batch.column(batch.schema.get_field_index(c)).cast(schema.field(c).type) for c in keep]
            arrays += [pa.array(v, type=schema.field(len(keep) + i).type) for i, v in enumerate(rest)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*columns).mapInArrow(run, spec)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow() of a function that keeps the columns of docs, whatever their names; the text is ``text`` in its batches."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


# ---------------------------------------------------------------- joins beside a checked size


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most_rows: int = 50_000, salts: int = 64, salt_by: Column | None = None) -> DataFrame:
    """left join right on keys of which one may hold a third of left: right is broadcast if it is small, counted first;
    otherwise left is salted by ``salt_by`` and right repeated for each salt, so that a hot key is spread over many tasks."""
    if small_enough(right, most_rows):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(salt_by if salt_by is not None else F.struct(*left.columns)), F.lit(salts)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def hot_keys(counts: DataFrame, on: list[str], n: str) -> DataFrame:
    """``on, __salts``: keys with so many rows that one task should not take them all, from a table of keys and their counts.

    A key is hot if it has more than an eighth of what a shuffle partition holds on average, so there are at most eight
    hot keys for each partition: that bounds the table, whatever the rows.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(256, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return counts.where(F.col(n) > share).select(*on, F.ceil(F.col(n) / share).cast("int").alias("__salts"))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, salt_by: Column, how: str = "inner", hint: str | None = None) -> DataFrame:
    """left join right on keys of which left may hold any number of rows: rows of hot_keys() are dealt to as many tasks as their
    number asks for, and right's row of such a key is repeated for each. The table of hot keys is small by its making."""
    hot = F.broadcast(hot)
    dealt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt_by), F.col("__salts"))).cast("int")
    salted = left.join(hot, on, "left").withColumn("__salt", dealt).drop("__salts")
    spread = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(spread.hint(hint) if hint else spread, [*on, "__salt"], how).drop("__salt")


# ---------------------------------------------------------------- rows with columns of any names


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column ``__packed``, and further ones that no column of docs can clash with."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("__packed"), *more)


def unpacked(df: DataFrame, docs: DataFrame, given: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of ``__packed``, but those that are given; given ones that docs has not come after them."""
    given = given or {}
    held = [given.get(c, F.col("__packed").getField(c)).alias(c) for c in docs.columns]
    return df.select(*held, *(column.alias(c) for c, column in given.items() if c not in docs.columns))


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star passes.

    edges: two long columns. Returns ``node, component`` (the smallest node reachable) for every node with an edge to another.
    Each pass aggregates with partial sums, and deals the edges of a hub to as many tasks as their number asks for; each pass
    is written to the shared folder. The number of passes grows with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    now = materialize(pairs, "edges")
    partitions = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def with_least(rows: DataFrame, share: int) -> DataFrame:
        """rows beside the least v of their u; a u of more than ``share`` rows is dealt out, at most 16 for each partition."""
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = least.where(F.col("n") > share).select("u", F.ceil(F.col("n") / share).cast("int").alias("__salts"))
        return join_hot(rows, least.drop("n"), ["u"], hot, F.col("v"))

    known = digest(now)
    for _ in range(rounds):
        share = max(256, known[0] // (8 * partitions))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, share).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = with_least(large, share)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v")))
        after = materialize(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(now)
        now, before, known = after, known, digest(after)
        if before == known:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} passes")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def spread_buckets(members: DataFrame, key: str, few: int, chunk: int, salt_by: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets of 2 to ``few`` rows, and those of larger buckets with the group of bounded size each belongs to.

    A bucket of more than ``chunk`` rows is cut into chunks of about that many; each row goes to every pair of chunks that
    has its own, so every two rows of a bucket still meet in some group (key, __c, __d) of at most about 2 * ``chunk`` rows.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    shared = materialize(members.join(sizes, key), "shared")
    small = shared.where(F.col("__n") <= few).select(*members.columns)
    whole = shared.where((F.col("__n") > few) & (F.col("__n") <= chunk))
    whole = whole.select(*members.columns, F.lit(0).alias("__c"), F.lit(0).alias("__d"))
    chunks = F.ceil(F.col("__n") / chunk).cast("int")
    dealt = shared.where(F.col("__n") > chunk).withColumn("__own", F.pmod(salt_by, chunks).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return small, whole.union(dealt.select(*members.columns, F.least("__own", "__other"), F.greatest("__own", "__other")))
