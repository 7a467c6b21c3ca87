"""Corpus pipeline over ``documents``: rules, line dedup, near-dedup, source mixing and packing.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, whatever other columns
``docs`` has; ``n_chars`` is counted anew where a text has changed. An empty table goes
through all stages. Very long texts are read whole by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.llm import lines, mixing, packing, quality, shingles
from vecscore.llm.common import DOCUMENT_COLUMNS, materialise, read
from vecscore.llm.queries import tokenizer_files


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their hosts' boilerplate lines.

    Null and empty texts have too few words and go. A null source is a host, a null doc_id an
    id; rows alike in id, source and text stay or go together. A line held by exactly the limit stays.
    """
    return _as_documents(quality.without_frequent_lines(docs, quality.quality_rules(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; documents stay, if need be without text.

    Null texts stay null, empty ones empty. A null doc_id is before all others; of equal ids the
    smaller text hash is earlier; rows alike in id and text lose like lines.
    """
    return _as_documents(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    The SimHash tries, over fingerprints of 320 bits, find pairs of texts whose five-word
    shingles have a Jaccard similarity of 0.8 or more; the shingles themselves decide. Null and
    empty texts are one group; a null doc_id stays only in a group without any other;
    one of rows alike in id and text stays; a similarity of exactly 0.8 links.
    """
    return shingles.one_of_each(docs, words=5, percent=80).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts without words have size 0, and any number of them is within the mix; a null source
    is a source, the last; rows alike in id and text share their copies out among them.
    """
    return mixing.repeated(docs, mixing.mix(docs)).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place, and ``copy``, which tells the copies that the mix made apart.

    Null and empty texts are one piece, their end id; a null doc_id is an id.
    """
    return packing.numbered_copies(packing.pack_documents(docs, **tokenizer_files()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has no tokenizer, cube method or components of unbounded depth; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
