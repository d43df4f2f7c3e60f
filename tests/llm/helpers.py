"""Small tables for the corpus operators: nulls, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None, None)[: 4 - len(r)], None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def with_clash(df, *names):
    """df with further columns, named as an operator's own ones may be."""
    for n in names:
        df = df.withColumn(n, df[df.columns[0]].cast("string"))
    return df


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "some words of no document at all"), (4, "x"), (4, "x"), (5, "word " * 30_000), (None, None)]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)
