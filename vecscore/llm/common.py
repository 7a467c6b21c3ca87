"""Shared pieces of the training-data operators: reading, words, keys, shared-folder tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.staging import materialise, spread, work_dir  # noqa: F401

#: The white space of the word contracts: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between white space; an empty or null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def count_words(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:  # a table without rows may have no file
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Working tables of one step, deleted once its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def drop(self) -> None:
        for table in self.tables:
            drop_table(table)
        self.tables = []


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as ``row``, with only the named columns beside it: no column of ``docs`` can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, those named replaced, and others added."""
    own = [columns[c].alias(c) if c in columns else F.col("row").getField(c).alias(c) for c in docs.columns]
    return df.select(*own, *[c.alias(n) for n, c in columns.items() if n not in docs.columns])


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table planned wholly in the JVM."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]

    def value(x, kind):
        if isinstance(x, list | tuple):
            return F.array(*[F.lit(y) for y in x]).cast(kind)
        return F.lit(x).cast(kind)

    structs = [F.struct(*[value(x, kind).alias(name) for x, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    kind = "array<struct<" + ",".join(f"{n}:{k}" for n, k in fields) + ">>"
    return spark.range(1).select(F.inline(F.array(*structs).cast(kind)))
