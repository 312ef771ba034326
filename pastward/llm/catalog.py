"""Registered queries of the operators; SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.llm import (
    bpe,
    chat,
    conversation_repair,
    decontamination,
    language,
    license_scan,
    near_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    warc,
)
from pastward.llm.work import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(substring_dedup.SQL)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents"))


@query(near_dedup.SQL)
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85).drop("mark")


@query()
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


@query()
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(table(spark, folder, "documents"))


@query(decontamination.SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("mark")


@query(chat.SQL)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of many layouts: see ``chat.turns_to_records``."""
    turns = chat.rows_to_turns(chat.with_sample(table(spark, folder, "conversations")))
    return chat.digests(chat.through_records(turns))


@query(quality_rules.SQL)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


def file_path() -> Column:
    """``source/lang/block/part/doc_id``: a block is a range of 20 000 ids, a part the remainder by 4. A null source or
    language is ``_``; without an id the path is null.

    Ids divisible by 11 are licence files ``LICENSE.doc_id``; their quotient's remainder by 4 says how many of the four
    directories they lie below: 1 to 4.
    """
    id_ = F.col("doc_id")
    parts = [F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.expr("doc_id div 20000").cast("string"), F.pmod(id_, F.lit(4)).cast("string")]
    above = F.slice(F.array(*parts), F.lit(1), (F.pmod(F.expr("doc_id div 11"), F.lit(4)) + 1).cast("int"))
    licence = F.concat(F.array_join(above, "/"), F.lit("/LICENSE."), id_.cast("string"))
    return F.when(F.pmod(id_, F.lit(11)) == 0, licence).otherwise(F.concat(F.array_join(F.array(*parts), "/"), F.lit("/"), id_.cast("string")))


@query()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree, some of them licence files: see ``file_path``."""
    docs = table(spark, folder, "documents")
    found = license_scan.scan(docs.select(file_path().alias("path"), "text")).drop("mark")
    return found.select(F.regexp_extract("path", "-?[0-9]+$", 0).cast("long").alias("doc_id"), "*")


@query()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(periodic_runs.SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, folder, "documents"))))


@query(warc.SQL)
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"))


@query(conversation_repair.SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversation_repair.with_all(conversation_repair.audited(conversation_repair.damaged(rows)), rows)
