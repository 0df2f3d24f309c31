"""Ticket lookup: ticket id -> status and category, one row per id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforge.functions import status as st
from replyforge.functions.text import sanitize_collection
from replyforge.operators.joins import asked_for, lookup_join, salted_left_join

TICKET_FIELDS = ["data_from", "loan_status", "repayment_status", "lr_status", "category_raw"]


def first_per_ticket(tickets: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The first row of each ticket id in source order.

    An aggregate, not a window: each task keeps one row per id before the shuffle,
    so an id with very many rows cannot fill a task.
    """
    fields = fields or TICKET_FIELDS
    return (
        tickets.where(F.col("ticket").isNotNull())
        .groupBy("ticket")
        .agg(F.min_by(F.struct(*fields), "src_order").alias("r"))
        .select("ticket", "r.*")
    )


def by_id(tickets: DataFrame) -> DataFrame:
    """A row for each id a ticket can be asked by; ``_kind`` is 0 for the main id, 1 for the alternative one.

    Exploded from one scan, so that nothing before it is computed twice.
    """
    ids = F.array(
        F.struct(F.col("ticket").alias("id"), F.lit(0).alias("kind")),
        F.struct(F.col("alt_ticket").alias("id"), F.lit(1).alias("kind")),
    )
    rest = [c for c in tickets.columns if c not in ("ticket", "alt_ticket")]
    return (
        tickets.select(F.explode(ids).alias("_key"), *rest)
        .where(F.col("_key.id").isNotNull())
        .select(F.col("_key.id").alias("ticket"), F.col("_key.kind").alias("_kind"), *rest)
    )


def ticket_index(keyed: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id: the first row by main id, else the first by alternative id."""
    return (
        keyed.groupBy("ticket")
        .agg(F.min_by(F.struct("_kind", *fields), F.struct("_kind", "src_order")).alias("r"))
        .select(
            "ticket",
            F.when(F.col("r._kind") == 0, "direct").otherwise("alternative").alias("matched_by"),
            *[f"r.{f}" for f in fields],
        )
    )


def look_up(
    emails: DataFrame,
    tickets: DataFrame,
    fields: list[str],
    derive: Callable[[DataFrame], DataFrame] = lambda df: df,
    spread: Sequence[str] = ("src_order",),
) -> DataFrame:
    """Emails with the fields of their ticket; ``matched_by`` is ``none`` on a miss.

    Main and alternative id are one index, so there is one join and the emails are
    shuffled once. Only tickets that are asked for are put through ``derive`` and sorted
    into the index, when the asked ids are few.
    """
    keyed = derive(asked_for(by_id(tickets), emails, ["ticket"]))
    joined = salted_left_join(emails, ticket_index(keyed, fields), ["ticket"], spread)
    return joined.withColumn("matched_by", F.coalesce("matched_by", F.lit("none")))


def classify(tickets: DataFrame, category_map: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Tickets with ``status`` and ``category``; row-local unless a map table is too big to broadcast."""
    named = st.with_status(tickets, compat).withColumn("category", st.lower_category(F.col("category_raw"), compat))
    return map_categories(named, "category", category_map)


def map_categories(
    df: DataFrame,
    column: str,
    category_map: DataFrame | None,
    spread: list[str] | None = None,
    lower_key: bool = False,
) -> DataFrame:
    """``column`` replaced by its mapped name; kept when the map has none.

    Without ``category_map`` (raw, collection) the fixed map is used as a literal.
    """
    key = F.lower(F.col(column)) if lower_key else F.col(column)
    if category_map is None:
        return df.withColumn(column, F.coalesce(st.map_category(key, keep=False), column))
    pairs = category_map.select(F.col("raw").alias("_raw"), F.col("collection").alias("_mapped"))
    joined = lookup_join(df.withColumn("_raw", key), pairs, ["_raw"], spread or ["src_order"])
    return joined.withColumn(column, F.coalesce("_mapped", column)).drop("_raw", "_mapped")


def resolve_tickets(
    emails: DataFrame, tickets: DataFrame, category_map: DataFrame | None = None, compat: bool = True
) -> DataFrame:
    """Emails with ``status``, ``category`` and ``matched_by``; ids without a ticket get ``not_found``."""
    found = look_up(emails, tickets, ["status", "category"], lambda df: classify(df, category_map, compat))
    return found.withColumn("status", F.coalesce("status", F.lit(st.NOT_FOUND))).withColumn(
        "category", F.coalesce("category", F.lit(st.NOT_FOUND))
    )


def name_collection(df: DataFrame, category_map: DataFrame | None = None, manual: bool = False) -> DataFrame:
    """``collection`` of a routed email, by the rules of the batch or of the single-ticket path.

    ``skipped`` is decided on the category as it is, before any character is replaced.
    """
    settled = df.withColumn("status", st.remap_status(F.col("status")))
    if manual:
        renamed = settled.withColumn("collection", st.remap_category(F.col("category")))
        mapped = map_categories(renamed, "collection", category_map, lower_key=True)
        return mapped.withColumn("skipped", F.col("collection").isin(st.SKIPPED_CATEGORIES))
    skipped = settled.withColumn("skipped", F.col("category").isin(st.SKIPPED_CATEGORIES))
    plain = skipped.withColumn("collection", sanitize_collection(F.col("category")))
    remapped = map_categories(plain, "collection", category_map)
    return remapped.withColumn("collection", st.remap_category(F.col("collection")))
