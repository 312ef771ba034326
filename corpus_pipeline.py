"""The stages that turn ``documents`` into tokens; each one's result is written and read again by the next.

All stages take any columns beside doc_id and text and carry them, whatever their names; an empty table gives an empty table; a long text is
worked on as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.llm import bpe, decontamination, language, near_dedup, substring_dedup
from pastward.llm.work import Work, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go, so null and empty texts do too.

    Every row is judged alone: repeated rows stay or go together. Rows without an id are judged but not learnt from; a null lang teaches nothing. Of
    languages at equal distance the first by name is taken.
    """
    return language.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Texts are linked from 80 % of five-word shingles on. Repeated rows stay once; rows that share an id are one document; texts without words, null
    ones included, are nobody's duplicates. Rows without an id take part, and stay only in groups where no row has one.
    """
    return near_dedup.one_of_each(docs, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that repeat are taken out of the texts; no row goes.

    The kept words of a changed text are joined by one space, and ``n_chars`` is counted anew. Null, empty and short texts stay as they are; repeated rows
    repeat each other's passages.
    """
    out = substring_dedup.without_repeated_passages(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped of which windows of benchmark items cover a twentieth or more.

    Null and empty texts have no words and stay; repeated rows fare alike; items without words hit nothing, an empty table of items neither.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to, one row for each document.

    A null text counts as empty: no tokens. Repeated rows give equal rows.
    """
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each result is written below the shared folder and deleted when the next one is; the last result reads the one
    before it, which stays with the folder. Odd rows fare as each stage says."""
    docs = table(spark, sf_dir, "documents")
    work, last = Work(spark), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, before = work.put(docs), last
            work.drop(before)
            last = docs
    return docs
