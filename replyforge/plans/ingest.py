"""Ingest: sheets to stored collections, field catalog and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.functions.text import kb_text
from replyforge.functions.vectors import DIM, Embedder, embed_hashed
from replyforge.operators.catalog import verify_content, with_placeholders
from replyforge.session import folders_listed
from replyforge.sources import store
from replyforge.sources.readers import Sheets, read_sheets
from replyforge.sources.schemas import KB
from replyforge.sources.writers import write_collections

STORED_KB = f"{KB}, is_placeholder boolean"
FIELDS = "field string, ordinal int, collection string"
REPORT = "collection string, file string, state string, similar string, expected bigint, stored bigint, complete boolean, intact boolean"


def embed_sheet_rows(rows: DataFrame, embed: Embedder = embed_hashed) -> DataFrame:
    """Sheet rows with the vector of their subject and body."""
    text = rows.withColumn("_text", kb_text(F.col("subject"), F.col("email_body")))
    return embed(text, "_text", "vector").drop("_text")


def ingest_sheets(
    spark: SparkSession, source: str | Sequence[str], target: str, embed: Embedder = embed_hashed, dim: int = DIM, **reading
) -> Sheets:
    """Read, check, embed and store sheets; only the collections of good sheets are replaced, all at once.

    Tables of the store: ``kb`` (by collection), ``fields`` (by collection) and ``report``. They are written to
    new folders and become the current state together. A good sheet without rows gets a placeholder row.
    The report compares the stored rows with the delivered ones, by number and by content.
    """
    before = store.read_state(spark, target)
    sheets = read_sheets(spark, source, **reading)
    good = sheets.report.where(F.col("state") == "ok")
    part = store.new_part()
    written = with_placeholders(embed_sheet_rows(sheets.rows, embed), good.select("collection"), dim)
    write_collections(written, store.folder(target, "kb", part))
    write_collections(sheets.fields, store.folder(target, "fields", part))
    with folders_listed(spark):
        kb = spark.read.schema(STORED_KB).parquet(store.folder(target, "kb", part))
    verified = verify_content(kb.where(~F.col("is_placeholder")), sheets.rows, good.select("collection", "expected"))
    report = sheets.report.join(verified.select("collection", "stored", "complete", "intact"), "collection", "left")
    for check in ("stored", "complete", "intact"):
        report = report.withColumn(check, F.when(F.col("state") == "ok", F.col(check)))
    report.write.parquet(store.folder(target, "report", part))
    # One name a collection; the state of the store lists them all.
    delivered = [r[0] for r in good.select("collection").collect()]
    kept = before.without(delivered)
    added = [store.Part(part, sorted(delivered))] if delivered else []
    store.publish(spark, target, store.State(before.version, [*kept, *added], part, []))
    return read_store(spark, target)


def read_store(spark: SparkSession, path: str) -> Sheets:
    """Knowledge base, field catalog and report of one state of the store."""
    state = store.read_state(spark, path)
    return Sheets(
        store.read_table(spark, path, "kb", STORED_KB, state),
        store.read_table(spark, path, "fields", FIELDS, state),
        store.read_report(spark, path, REPORT, state),
    )


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """The stored knowledge base."""
    return read_store(spark, path).rows
