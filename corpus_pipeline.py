"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes the documents that the one before it kept; its output is written as Parquet and
read again. All stages but the last return the columns of ``documents``.

All stages judge row by row: rows that share a doc_id, or have none, are documents of their own. Extra
columns travel along unread, whatever their names (only ``row_number_`` and ``batch_`` are taken).
Texts are read whole, however long. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwise.llm.classifier import accepted, fit
from cellwise.llm.common import cut, table
from cellwise.llm.decontaminate import clean
from cellwise.llm.packing import pack
from cellwise.llm.queries import tokenizer
from cellwise.llm.simhash import keep_one
from cellwise.llm.substring_dedup import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects.

    Null and empty texts get the score of no evidence, all alike. Equal texts and repeated rows stay or go
    together. Without labels nothing is rejected (a score of 0.5 stays).
    """
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the smallest doc_id, of every SimHash group.

    Of rows that share that doc_id the first stays; a null doc_id comes after all others. Null texts, empty
    texts and texts without words are one group.
    """
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out words in windows of 50 that an earlier document has as well.

    Every row stays, if with an empty text. Null texts stay null. Earlier is smaller by (doc_id, row), a null
    doc_id before all others; of equal texts the earliest keeps its words.
    """
    return strip_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a verbatim match of 13 benchmark words, or a twentieth covered by shorter items.

    Null and empty texts stay. Equal texts and repeated rows stay or go together. An empty benchmark drops
    nothing; items without text match nothing.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token sequences.

    Null texts are the end id alone. Every row is packed on its own, ties in length in any order.
    """
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Compression sizes and token ids have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
