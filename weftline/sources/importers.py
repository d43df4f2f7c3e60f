"""Edges from CSV and JSON lines: rows are parsed on the executors, good ones committed, bad ones handed back with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import now_ns, parse_ns_column
from ..schema import PROPS
from .bulk import bulk_add_edges, problem
from .store import Store, Version

JSONL_ENDINGS = ("jsonl", "ndjson", "json")
CSV_COLUMNS = ("from", "to", "edge_type", "valid_from", "valid_to", "observed_at", "source", "confidence")


def format_of(path: str, given: str | None = None) -> str:
    return given or ("jsonl" if path.rsplit(".", 1)[-1].lower() in JSONL_ENDINGS else "csv")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, number`` of all lines that are not blank, numbered from 1 within their file, in the order of files and lines.

    Large files are split over tasks: a line's number is that within its split, plus the lines of the splits before, which are
    counted first. The table of counts has a row for each split and is broadcast; a hundred thousand splits are some megabytes.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    each = spark.read.text(path, lineSep="\n").select("value", *split, F.monotonically_increasing_id().alias("id"))
    counts = each.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    offsets = counts.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    held = each.join(F.broadcast(offsets), ["file", "block"])
    return held.select((F.col("id") + F.col("shift")).alias("number"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line")).where("line <> ''")


def _time(text: Column, default: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(parse_ns_column(text))


def _bad_time(*fields: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in fields:
        bad = (F.coalesce(text, F.lit("")) != "") & parse_ns_column(text).isNull()
        out = F.coalesce(out, F.when(bad, F.concat(F.lit(f"cannot parse {name}: "), text)))
    return out


def parse_csv(lines: DataFrame, now: int) -> DataFrame:
    """EDGE_INPUT columns, ``number`` and ``error`` from ``number, line``. Commas always split, also within quotes."""
    parts = F.transform(F.split("line", ","), lambda p: F.regexp_replace(F.trim(p), r'^"(.*)"$', "$1"))
    held = lines.withColumn("parts", parts)
    cell = {c: F.get("parts", F.lit(i)) for i, c in enumerate(CSV_COLUMNS)}
    start = _time(cell["valid_from"], F.lit(now))
    confidence = F.when(F.coalesce(cell["confidence"], F.lit("")) == "", F.lit(1.0)).otherwise(cell["confidence"].try_cast("float"))
    error = F.coalesce(
        F.when(F.size("parts") < 3, F.concat(F.lit("expected at least 3 columns (from,to,edge_type), got "), F.size("parts").cast("string"))),
        _bad_time(*((c, cell[c]) for c in ("valid_from", "valid_to", "observed_at"))),
        F.when(confidence.isNull(), F.concat(F.lit("bad confidence: "), cell["confidence"])),
    )
    return held.select(
        "number", "line", cell["from"].alias("from"), cell["to"].alias("to"), cell["edge_type"].alias("edge_type"), start.alias("valid_from_ns"), _time(cell["valid_to"], F.lit(None).cast("long")).alias("valid_to_ns"),
        _time(cell["observed_at"], start).alias("observed_at_ns"), F.coalesce(cell["source"], F.lit("")).alias("source"), confidence.cast("float").alias("confidence"), F.create_map().cast(PROPS).alias("props"), error.alias("error"),
    )


def parse_jsonl(lines: DataFrame, now: int) -> DataFrame:
    """The same from JSON objects. A field of another type than expected counts as missing; arrays are errors."""
    held = lines.withColumn("v", F.try_parse_json("line")).withColumn("kind", F.schema_of_variant("v"))

    def text(name: str) -> Column:
        raw = F.get_json_object("line", f"$.{name}")
        quoted = F.rlike(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")), F.lit("^STRING$"))
        return F.when(quoted, raw)

    start = _time(text("valid_from"), F.lit(now))
    given = F.schema_of_variant(F.try_variant_get("v", "$.confidence", "variant"))
    confidence = F.when(F.rlike(given, F.lit("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$")), F.try_variant_get("v", "$.confidence", "double")).otherwise(F.lit(1.0))
    error = F.coalesce(
        F.when(F.col("v").isNull() | ~F.startswith("kind", F.lit("OBJECT")), F.lit("not a JSON object")),
        F.when(F.contains("kind", F.lit("ARRAY<")), F.lit("arrays are not supported")),
        *(F.when(text(c).isNull(), F.lit(f"missing '{c}'")) for c in ("from", "to", "edge_type")),
        _bad_time(*((c, text(c)) for c in ("valid_from", "valid_to", "observed_at"))),
    )
    values = F.try_variant_get("v", "$.properties", "map<string,variant>")
    typed = F.transform_values(F.coalesce(values, F.create_map().cast("map<string,variant>")), lambda _, x: _prop(x))
    props = F.map_filter(typed, lambda _, x: x.isNotNull())
    return held.select(
        "number", "line", text("from").alias("from"), text("to").alias("to"), text("edge_type").alias("edge_type"), start.alias("valid_from_ns"), _time(text("valid_to"), F.lit(None).cast("long")).alias("valid_to_ns"),
        _time(text("observed_at"), start).alias("observed_at_ns"), F.coalesce(text("source"), F.lit("")).alias("source"), confidence.cast("float").alias("confidence"), props.cast(PROPS).alias("props"), error.alias("error"),
    )


def _prop(x: Column) -> Column:
    """A stored property; whole numbers are ints, nested objects null."""
    kind = F.schema_of_variant(x)
    number = F.try_variant_get(x, "$", "double")
    whole = (number == F.floor(number)) & F.abs(number).__lt__(F.lit(2.0**63))

    def made(t: str, v: Column) -> Column:
        return F.struct(F.lit(t).alias("t"), v.alias("v"))

    return (
        F.when(x.isNull() | (kind == "VOID"), made("null", F.lit("")))
        .when(kind == "BOOLEAN", made("bool", F.try_variant_get(x, "$", "string")))
        .when(kind == "STRING", made("string", F.try_variant_get(x, "$", "string")))
        .when(F.startswith(kind, F.lit("OBJECT")), F.lit(None))
        .when(whole, made("int", number.cast("long").cast("string")))
        .otherwise(made("float", number.cast("string")))
    )


@dataclass
class Imported:
    version: Version
    count: int
    errors: DataFrame  # number, error


def import_edges(store: Store, path: str, given: str | None = None, now: int | None = None, parity: bool = False) -> Imported:
    """Import a file, or folder of files, as one commit: bad rows do not stop good ones.

    A CSV's first line is a header if it starts with from. Files of any size are split over tasks.
    """
    now = now_ns() if now is None else now
    kind = format_of(path, given)
    lines = _lines(store.spark, path)
    if kind == "csv":
        header = F.startswith("line", F.lit("from,")) | F.startswith("line", F.lit('"from"'))
        lines = lines.where(~(header & (F.col("number") == 1)))
    rows = (parse_csv if kind == "csv" else parse_jsonl)(lines, now)
    rows = rows.withColumn("error", F.coalesce("error", problem()))
    before = store.version()
    version = bulk_add_edges(store, rows.where("error is null" if not parity else "valid_from_ns is not null").drop("number", "line", "error"), before, parity)
    return Imported(version, version.counts["edges"] - before.counts["edges"], rows.where("error is not null").select("number", "error").orderBy("number"))
