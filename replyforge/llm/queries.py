"""Registered queries of the corpus operators, each with its checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from replyforge.llm import conversation_repair, conversation_trie, exact_dedup, fingerprints, language, line_dedup, near_dedup, packing, pieces, private_data, quality, substring_dedup, suffix_dedup
from replyforge.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, table: str = "documents"):
    """Register a query over one table."""

    def register(build: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op1_line_dedup", line_dedup.SQL)
def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(docs))


@query("op4_quality_rules")
def op4_quality_rules(docs: DataFrame) -> DataFrame:
    return quality.judge(docs).drop("fp")


@query("op6_exact_dedup", exact_dedup.SQL)
def op6_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_dedup.exact_groups(docs)


@query("op8_private_data")
def op8_private_data(docs: DataFrame) -> DataFrame:
    return private_data.digest(private_data.find(docs))


@query("op9_language_id")
def op9_language_id(docs: DataFrame) -> DataFrame:
    return language.identify(docs)


@query("op7_packing")
def op7_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(docs)


@query("op2_sentence_pieces")
def op2_sentence_pieces(docs: DataFrame) -> DataFrame:
    return pieces.digest(pieces.decode(pieces.encode(docs)))


@query("op5_substring_dedup")
def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(docs))


@query("op10_suffix_dedup")
def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_suffixes(docs))


@query("op3_near_dedup")
def op3_near_dedup(docs: DataFrame) -> DataFrame:
    return near_dedup.near_groups(docs, near_dedup.Likeness(words=2, percent=80)).drop("fp")


@query("op11_conversation_repair", conversation_repair.SQL, table="conversations")
def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    return conversation_repair.digest(conversations)


@query("op13_conversation_trie", conversation_trie.SQL, table="conversations")
def op13_conversation_trie(conversations: DataFrame) -> DataFrame:
    return conversation_trie.digest(conversations)


@query("op12_fingerprints")
def op12_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints.fingerprint_pairs(docs)
