"""Writers for the knowledge base, results, envelopes and reply texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.session import COALESCED, configured
from replyforge.sources.schemas import RESULTS

RESULT_BUCKETS = 256


def ticket_key(ticket: Column) -> Column:
    """A ticket id as a key that is never null: one for all missing ids, and other than any id."""
    return F.coalesce(F.concat(F.lit("="), ticket.cast("string")), F.lit(""))


def write_collections(kb: DataFrame, path: str) -> None:
    """Replace the collections that ``kb`` holds and leave the others as they are.

    The rebalance hint gathers a collection's rows into few files and lets the
    adaptive planner split a collection that is too big for one task. Small
    partitions stay apart: a file is work however few its bytes are, and one task
    would write those of all small collections.
    """
    with configured(kb.sparkSession, COALESCED, "false"):
        (
            kb.hint("rebalance", "collection")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("collection")
            .parquet(path)
        )


def save_collections(kb: DataFrame, table: str) -> None:
    """The knowledge base as a catalog table, so that single collections can be dropped from it."""
    kb.hint("rebalance", "collection").write.mode("overwrite").partitionBy("collection").format("parquet").saveAsTable(table)


def drop_collection(spark: SparkSession, table: str, collection: str) -> None:
    value = collection.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (collection = '{value}')")


def drop_all_collections(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def append_results(results: DataFrame, path: str) -> None:
    """Add one batch of result rows to the table."""
    results.to(results.sparkSession.createDataFrame([], RESULTS).schema).write.mode("append").parquet(path)


def append_bucketed(results: DataFrame, table: str, buckets: int = RESULT_BUCKETS) -> None:
    """Add one batch of result rows to a catalog table dealt out by ticket, which a resume reads without moving it.

    ``ticket_key`` stands for the ticket, also for a missing one.
    """
    rows = results.to(results.sparkSession.createDataFrame([], RESULTS).schema).withColumn("ticket_key", ticket_key(F.col("ticket")))
    rows = rows.repartition(buckets, "ticket_key")
    rows.write.mode("append").format("parquet").bucketBy(buckets, "ticket_key").sortBy("ticket_key").saveAsTable(table)


def export_csv(results: DataFrame, path: str) -> None:
    """Result rows as CSV, one file per task."""
    results.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """One JSON envelope per line; earlier envelopes are replaced."""
    envelopes.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_reply_texts(replies: DataFrame, path: str, column: str = "reply") -> None:
    """Printed replies one after the other."""
    replies.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
