"""Metadata queries: predicates over fields, field detection, limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.functions.status import SKIPPED_CATEGORIES

# Name parts that mark a field's role, and the fields that hold no text.
SUBJECT_PARTS = ["subject", "title", "query"]
BODY_PARTS = ["body", "content", "text", "message", "email"]
TECHNICAL_FIELDS = ["id", "embedding"]


def all_equal(wanted: Mapping[str, str]) -> Column:
    return reduce(and_, [F.col(c) == v for c, v in wanted.items()])


def first_rows(df: DataFrame, order: Sequence[str], n: int | None, offset: int = 0) -> DataFrame:
    """``n`` rows from ``offset`` on in a total order; all rows without ``n``."""
    if n is None and not offset:
        return df
    skipped = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return skipped if n is None else skipped.limit(n)


def equal_rows(df: DataFrame, wanted: Mapping[str, str], order: Sequence[str], n: int = 10) -> DataFrame:
    return first_rows(df.where(all_equal(wanted)), order, n)


def field_by_pattern(kb_fields: DataFrame, pattern: str) -> DataFrame:
    """First field of each collection whose name contains ``pattern`` in any letter case."""
    matching = kb_fields.where(F.contains(F.lower("field"), F.lit(pattern.lower())))
    return matching.groupBy("collection").agg(F.min_by("field", "ordinal").alias("field"))


def equality_expression(subject_field: Column, subject: Column, status_field: Column, status: Column) -> Column:
    def quoted(field: Column, value: Column) -> Column:
        return F.concat(field, F.lit(' == "'), value, F.lit('"'))

    return F.concat(quoted(subject_field, subject), F.lit(" and "), quoted(status_field, status))


def query_check(subject: Column, status: Column, expression: Column) -> Column:
    """``no_input``, ``none_value`` or ``ok`` for an equality query."""
    missing = (F.coalesce(subject, F.lit("")) == "") | (F.coalesce(status, F.lit("")) == "")
    return F.when(missing, "no_input").when(F.contains(expression, F.lit("None")), "none_value").otherwise("ok")


def any_contains(columns: Sequence[Column], part: str) -> Column:
    """One of the columns contains ``part`` literally; missing values do not."""
    return reduce(or_, [F.coalesce(F.contains(c, F.lit(part)), F.lit(False)) for c in columns])


def any_cell_contains(cells: Column, part: str) -> Column:
    """One value of a field map contains ``part``."""
    return F.exists(F.map_values(cells), lambda v: F.contains(v, F.lit(part)))


def field_roles(kb_fields: DataFrame) -> DataFrame:
    """First subject-like and first body-like field of each collection."""

    def first_with(parts: Sequence[str]) -> Column:
        has_part = reduce(or_, [F.contains(F.lower("field"), F.lit(p)) for p in parts])
        # A NULL order is ignored, so only matching fields compete.
        return F.min_by("field", F.when(has_part, F.col("ordinal")))

    return kb_fields.groupBy("collection").agg(
        first_with(SUBJECT_PARTS).alias("subject_field"), first_with(BODY_PARTS).alias("body_field")
    )


def squared_length(vector: Column) -> Column:
    """Squared L2 distance to the zero vector."""
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def filtered_search(kb: DataFrame, condition: Column, n: int = 5) -> DataFrame:
    """Per collection the ``n`` rows closest to the zero vector among those that pass ``condition``.

    ``kb`` has collection, kb_id and vector. The score is rounded so that unit vectors tie and the id decides.
    """
    scored = kb.where(condition).withColumn("score", F.round(squared_length(F.col("vector")), 6)).drop("vector")
    order = Window.partitionBy("collection").orderBy("score", "kb_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def id_range(df: DataFrame, low: int, n: int, offset: int = 0) -> DataFrame:
    return first_rows(df.where(F.col("kb_id") >= low), ["kb_id"], n, offset)


def ids_in(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    return df.where(F.col("kb_id").isin(list(ids)))


def category_gate(category: Column) -> Column:
    """``skipped`` or ``empty_category`` where no search is made, else ``search``."""
    return (
        F.when(category.isin(SKIPPED_CATEGORIES), "skipped").when(category == "", "empty_category").otherwise("search")
    )


def text_fields(df: DataFrame, excluded: Sequence[str] = TECHNICAL_FIELDS) -> DataFrame:
    return df.drop(*excluded)
