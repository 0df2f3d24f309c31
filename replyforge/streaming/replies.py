"""Replies for emails as they arrive: the resumable batch as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from replyforge.plans.batch import Knowledge, reply_to_batch
from replyforge.sources.readers import CSV_OPTIONS
from replyforge.sources.schemas import RESULTS
from replyforge.sources.writers import ticket_key

EMAILS = "ticket string, src_order bigint, subject string, email_body string"


def read_email_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Email CSV files as they are put into a folder."""
    return spark.readStream.schema(EMAILS).option("maxFilesPerTrigger", files_per_trigger).csv(path, header=True, **CSV_OPTIONS)


def read_result_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Result files as they are put into a folder, each read once."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _first_seen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The emails of a ticket that was not seen before this micro-batch; from now on it was."""
    if state.exists:
        return
    state.update((True,))
    # A result of the ticket sorts before its emails nowhere, so all of them are looked at before one is given out.
    held, answered = [], False
    for frame in frames:
        answered = answered or bool(frame["answered"].any())
        if not answered:
            held.append(frame.drop(columns=["ticket_key", "answered"]))
    if not answered:
        for frame in held:
            numbers = pd.to_numeric(frame["src_order"]).astype("Int64")
            yield frame.assign(src_order=numbers)


def not_done_stream(emails: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Emails whose ticket has no result and no email in an earlier micro-batch.

    What was seen is state by ticket, so a micro-batch costs what it brings and reads no earlier results again.
    ``earlier`` is a stream of results from elsewhere, each of which is read once. Emails of one ticket in one
    micro-batch all count. At scale keep the state with the RocksDB provider.
    """
    columns = ["ticket", "src_order", "subject", "email_body"]
    every = emails.select(*columns, F.lit(False).alias("answered"))
    if earlier is not None:
        told = earlier.select("ticket", *[F.lit(None).cast(emails.schema[c].dataType).alias(c) for c in columns[1:]], F.lit(True).alias("answered"))
        every = every.unionByName(told)
    # Numbers travel as text: a batch with a missing one would turn them into floats.
    keyed = every.withColumn("ticket_key", ticket_key(F.col("ticket"))).withColumn("src_order", F.col("src_order").cast("string"))
    return keyed.groupBy("ticket_key").applyInPandasWithState(_first_seen, EMAILS, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def start_replies(
    emails: DataFrame,
    ticket_rows: DataFrame,
    load_knowledge: Callable[[], Knowledge],
    results: str,
    checkpoint: str,
    once: bool = True,
    earlier: DataFrame | None = None,
    **options,
) -> StreamingQuery:
    """Append a result row for every email whose ticket has none yet.

    Each micro-batch is one run of the batch plan. It writes its own ``batch_id``
    folder, so a batch repeated after a failure replaces its rows; the state it started from is that
    of the batch before. ``earlier``: results of other runs, see ``read_result_stream``.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        replied = reply_to_batch(batch, ticket_rows, load_knowledge(), **options)
        replied.write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")

    writer = not_done_stream(emails, earlier).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
