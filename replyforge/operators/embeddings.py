"""Vectors kept by the digest of their text, so that a text is embedded once, however often it is asked for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.functions.vectors import Embedder, embed_hashed
from replyforge.operators.joins import fits_broadcast, salted_left_join

VECTORS = "text_key string, vector array<float>"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors, or none when there is no such table yet."""
    try:
        return spark.read.schema(VECTORS).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VECTORS)


def text_key(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def embed_new(df: DataFrame, text: str, path: str, embed: Embedder = embed_hashed) -> DataFrame:
    """Embed the texts of ``df`` that have no vector under ``path`` yet and add them there; returns all stored vectors.

    Equal texts are embedded once. A run that fails adds nothing, since one write appends whole files at its end.
    """
    spark = df.sparkSession
    known = read_vectors(spark, path).select("text_key")
    distinct = text_key(df.select(text), text).groupBy("text_key").agg(F.first(text).alias(text))
    fresh = distinct.join(known, "text_key", "left_anti")
    embedded = embed(fresh, text, "vector").select("text_key", F.col("vector").cast("array<float>").alias("vector"))
    embedded.write.mode("append").parquet(path)
    return read_vectors(spark, path)


def with_stored_vectors(df: DataFrame, text: str, path: str, spread: list[str], embed: Embedder = embed_hashed) -> DataFrame:
    """``df`` with ``vector`` from the table under ``path``, where missing texts are added first."""
    vectors = embed_new(df, text, path, embed)
    keyed = text_key(df, text)
    wanted = keyed.select("text_key").distinct()
    if fits_broadcast(wanted):
        # Few texts are asked for: the table is read where it lies and only theirs are moved.
        vectors = vectors.join(F.broadcast(wanted), "text_key", "left_semi")
    # Two runs at the same time may both have added a text.
    vectors = vectors.dropDuplicates(["text_key"])
    return salted_left_join(keyed, vectors, ["text_key"], spread).drop("text_key")
