"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.llm import line_dedup, near_dedup, packing, private_data, quality
from replyforge.llm.common import documents
from replyforge.session import materialise, ship_package


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    ship_package(spark)
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that occur before; those with nothing left go."""
    ship_package(spark)
    return _counted(line_dedup.remove_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 0.8 of its five-word shingles."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    ship_package(spark)
    return _counted(private_data.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that hold every id of every document once."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("private_data", personal_data),
    ("packing", packed),
]

# Graph search, estimation and tokenisation have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    ship_package(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
