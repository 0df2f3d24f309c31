"""Exact dedup by content sort: range partitions from sampled splitters, external sort, neighbour comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import chosen, without_space
from replyforge.session import materialise

SALTS = 64
HEAD_CHARACTERS = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical without ASCII white space. Of equal texts the longest
    original stays (code points), then the smallest doc_id; a missing id comes last.

    The normalised texts are dealt out by sampled range splitters over (head, digest, salt) - the
    head and the digest bound the size of a sampled key, however long a text is - and sorted
    externally inside each partition. Neighbours are then compared in full; each run of equal texts
    yields its first row. A hash of the id is the last part of the splitting key, so a group with a
    third of all rows is cut into ``SALTS`` runs that the splitters place in different partitions.
    The runs of one digest, at most ``SALTS`` narrow rows, are merged in a second, small shuffle.

    Null texts count as empty, and all empty texts are one group. Rows equal in all columns are
    copies: one of them stays. An empty table gives no rows. Further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        chosen(docs, id_col=id_col, text_col=text_col)
        .select("doc_id", F.char_length(text).cast("bigint").alias("len"), without_space(text).alias("norm"))
        .select(
            "doc_id",
            "len",
            "norm",
            F.left("norm", F.lit(HEAD_CHARACTERS)).alias("head"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.pmod(F.xxhash64("doc_id", "len"), F.lit(SALTS)).alias("salt"),
        )
    )
    best_first = [F.desc("len"), F.asc_nulls_last("doc_id")]
    # Clustered as the range partitions are, so the window adds a sort but no exchange.
    run = Window.partitionBy("head", "digest", "salt", "norm")
    runs = rows.repartitionByRange("head", "digest", "salt").select(
        "doc_id",
        "digest",
        "salt",
        "len",
        F.row_number().over(run.orderBy(*best_first)).alias("place"),
        F.count(F.lit(1)).over(run).alias("run_size"),
    )
    # Written once, without the texts: the groups and the result are both made from it.
    runs = materialise(runs, "exact-runs")
    group = Window.partitionBy("digest")
    merged = (
        runs.where("place = 1")
        .select(
            "digest",
            "salt",
            F.first("doc_id").over(group.orderBy(*best_first, "salt")).alias("keep_id"),
            F.sum("run_size").over(group).alias("group_size"),
            F.row_number().over(group.orderBy(*best_first, "salt")).alias("run_place"),
        )
    )
    return runs.join(merged, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & (F.col("run_place") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
placed AS (
  SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER best = 1 AS kept, norm
  FROM normal WINDOW best AS (PARTITION BY norm ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM placed
"""
