"""Catalog and profiling of collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.functions.text import MAX_TEXT, preview
from replyforge.functions.vectors import DIM
from replyforge.operators.filters import TECHNICAL_FIELDS
from replyforge.operators.search import collection_schemas
from replyforge.session import materialise

TEXT_FIELDS = ["subject", "email_body"]


def number_rows(df: DataFrame, column: str) -> DataFrame:
    """``number`` 1..n in the order of ``column``, counted per range partition and not in one task."""
    ranged = df.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    # Written once: the ranges come from a sample and must be the same for both uses.
    placed = materialise(ranged, "numbered")
    inside = Window.partitionBy("_part").orderBy(column)
    # One row per range partition.
    sizes = placed.groupBy("_part").count()
    before = sizes.select(
        "_part",
        (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"),
    )
    counted = placed.withColumn("_inside", F.row_number().over(inside))
    return counted.join(F.broadcast(before), "_part").select(
        (F.col("_before") + F.col("_inside")).alias("number"), *df.columns
    )


def list_collections(kb: DataFrame) -> DataFrame:
    """Collection names, sorted and numbered."""
    return number_rows(kb.select("collection").distinct(), "collection")


def collection_counts(kb: DataFrame, by: Sequence[str] = ("collection",)) -> DataFrame:
    """Rows per collection, or per combination of partition columns."""
    return kb.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def describe_fields(kb_fields: DataFrame, dim: int = DIM) -> DataFrame:
    """Name, type, key flags, description and parameters of every field in schema order."""
    name = F.col("field")
    is_id, is_vector = name == "id", name == "embedding"
    return kb_fields.select(
        "collection",
        "ordinal",
        "field",
        F.when(is_id, "INT64").when(is_vector, "FLOAT_VECTOR").otherwise("VARCHAR").alias("type"),
        is_id.alias("is_primary"),
        is_id.alias("auto_id"),
        F.lit("").alias("description"),
        F.when(is_id, "").when(is_vector, f"dim={dim}").otherwise(f"max_length={MAX_TEXT}").alias("params"),
    )


def searchable_fields(kb_fields: DataFrame) -> DataFrame:
    return kb_fields.where(~F.col("field").isin(TECHNICAL_FIELDS))


def fields_text(kb_fields: DataFrame) -> DataFrame:
    """Names other than subject and body of each collection in schema order, ``(none)`` when there are none."""
    others = F.filter("fields", lambda f: ~f.isin(TEXT_FIELDS))
    joined = F.coalesce(F.nullif(F.array_join(others, ", "), F.lit("")), F.lit("(none)"))
    return collection_schemas(kb_fields).select("collection", joined.alias("fields"))


def sample_rows(kb: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each collection by id; the limit also runs before the shuffle."""
    order = Window.partitionBy("collection").orderBy("kb_id")
    return kb.withColumn("sample", F.row_number().over(order)).where(F.col("sample") <= n)


def shown_vector(vector: Column) -> Column:
    return F.concat(F.lit("[Vector with "), F.size(vector).cast("string"), F.lit(" dimensions]"))


def shown(df: DataFrame, columns: Sequence[str], limit: int = 100, marker: str = "... [truncated]") -> DataFrame:
    """Text columns in display form."""
    return df.withColumns({c: preview(F.col(c), limit, marker) for c in columns})


def verify_ingest(kb: DataFrame, sheets: DataFrame) -> DataFrame:
    """Stored against delivered rows per collection. ``sheets``: collection, expected."""
    stored = collection_counts(kb).withColumnRenamed("rows", "stored")
    joined = sheets.join(stored, "collection", "full")
    return joined.select(
        "collection",
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.coalesce("expected", F.lit(0)) == F.coalesce("stored", F.lit(0))).alias("complete"),
    )


def content_fingerprint(rows: DataFrame) -> DataFrame:
    """``collection``, ``rows`` and ``fingerprint`` of its rows in any order.

    ``rows``: collection, kb_id, subject, email_body, fields (map). Each row is hashed with its cells in name
    order; sums of the two halves of the hashes are kept beside their exclusive or, so that neither equal pairs nor a
    changed cell cancel out. Adds up in the tasks.
    """
    cells = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("\x00"), F.coalesce(e["value"], F.lit("\x01"))))
    row = F.xxhash64("kb_id", F.coalesce("subject", F.lit("\x01")), F.coalesce("email_body", F.lit("\x01")), F.array_join(cells, "\x02"))
    return rows.select("collection", row.alias("h")).groupBy("collection").agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws(
            ":",
            F.hex(F.bit_xor("h")),
            F.sum(F.shiftrightunsigned("h", 32)).cast("string"),
            F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).cast("string"),
        ).alias("fingerprint"),
    )


def verify_content(stored: DataFrame, delivered: DataFrame, sheets: DataFrame) -> DataFrame:
    """``verify_ingest`` with ``intact``: whether the stored rows are the delivered ones, cell by cell."""
    found = content_fingerprint(stored).select("collection", F.col("fingerprint").alias("found"))
    sent = content_fingerprint(delivered).select("collection", F.col("fingerprint").alias("sent"))
    counted = verify_ingest(stored, sheets)
    both = counted.join(found, "collection", "left").join(sent, "collection", "left")
    return both.withColumn("intact", F.col("found").eqNullSafe(F.col("sent"))).drop("found", "sent")


def record_structure(kb: DataFrame, limit: int = 100) -> DataFrame:
    """Read-back of the first row of each collection: (collection, field, value) with long texts cut for display."""
    named = [c for c, t in kb.dtypes if c not in ("collection", "fields")]
    first = kb.groupBy("collection").agg(F.min_by(F.struct(*[c for c in kb.columns if c != "collection"]), "kb_id").alias("row"))
    types = dict(kb.dtypes)
    own = [
        F.struct(F.lit(c).alias("field"), (shown_vector(F.col(f"row.{c}")) if types[c].startswith("array") else F.col(f"row.{c}").cast("string")).alias("value"))
        for c in named
    ]
    cells = F.transform(F.map_entries("row.fields"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    entries = F.concat(F.array(*own), cells) if "fields" in types else F.array(*own)
    rows = first.select("collection", F.explode(entries).alias("e")).select("collection", "e.field", "e.value")
    return shown(rows, ["value"], limit, "...")


def with_placeholders(kb: DataFrame, sheets: DataFrame, dim: int = DIM) -> DataFrame:
    """``kb`` plus one flagged row with a zero vector and empty texts for every sheet without rows."""
    filled = kb.select("collection").distinct()
    empty = sheets.select("collection").distinct().join(filled, "collection", "left_anti")
    types = dict(kb.dtypes)
    row = {
        "collection": F.col("collection"),
        "kb_id": F.lit(0).cast(types["kb_id"]),
        "vector": F.array_repeat(F.lit(0.0), dim).cast(types.get("vector", "array<float>")),
    }
    placeholder = empty.select(
        *[row[c].alias(c) if c in row else F.lit("" if t == "string" else None).cast(t).alias(c) for c, t in kb.dtypes],
        F.lit(True).alias("is_placeholder"),
    )
    return kb.withColumn("is_placeholder", F.lit(False)).unionByName(placeholder)
