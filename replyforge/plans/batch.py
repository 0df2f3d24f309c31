"""The batch: emails through lookup, search and routing to one result row each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforge.functions.text import body_or_subject, escape_text, kb_text, query_text
from replyforge.functions.vectors import Embedder, embed_hashed
from replyforge.operators import replies, search, tickets
from replyforge.operators.cells import CellIndex, cell_topk
from replyforge.operators.embeddings import with_stored_vectors
from replyforge.operators.joins import fetch_rows, in_named_partitions, lookup_join, salted_anti_join, salted_left_join
from replyforge.session import materialise
from replyforge.sources.writers import ticket_key

RESULT_COLUMNS = ["ticket", "src_order", "subject", "email_body", "response_generated", "template_referred", "outcome", "error"]


@dataclass
class Knowledge:
    """What replies are made from.

    ``rows``: collection, kb_id, subject, email_body, fields (map), and ``vector`` when it is stored.
    ``fields``: collection, field, ordinal. ``templates``: collection, html.
    ``category_map``: raw, collection; None for the fixed map.
    ``index``: cell index over the rows; without it the search is a full one. With
    ``nprobe`` cells alone (by default as many as the index has measured) the answer is approximate, unless
    ``exact_cells`` is set.
    ``vectors``: folder of vectors by text; texts that have one there are not embedded again.
    """

    rows: DataFrame
    fields: DataFrame
    templates: DataFrame
    category_map: DataFrame | None = None
    index: CellIndex | None = None
    nprobe: int | None = None
    exact_cells: bool = True
    vectors: str | None = None


def best_rows(queries: DataFrame, knowledge: Knowledge, embed: Embedder = embed_hashed, k: int = 1) -> DataFrame:
    """Top ``k`` rows of each query (collection, query_id, vector) by the index or by a full search."""
    if knowledge.index is not None:
        return cell_topk(queries, knowledge.index, k, knowledge.nprobe, knowledge.exact_cells)
    if "vector" in knowledge.rows.columns:
        vectors = search.searchable(knowledge.rows).select("collection", "kb_id", "vector")
    else:
        vectors = embed_rows(knowledge.rows, embed, knowledge.vectors)
    return search.exact_topk(queries, vectors, k)


def embed_rows(rows: DataFrame, embed: Embedder = embed_hashed, stored: str | None = None) -> DataFrame:
    """Knowledge-base vectors: collection, kb_id, vector; from the folder ``stored`` where their text was embedded before."""
    text = search.searchable(rows).select(
        "collection", "kb_id", kb_text(F.col("subject"), F.col("email_body")).alias("_text")
    )
    if stored is not None:
        return with_stored_vectors(text, "_text", stored, ["kb_id"], embed).select("collection", "kb_id", "vector")
    return embed(text, "_text", "vector").select("collection", "kb_id", "vector")


def route(emails: DataFrame, ticket_rows: DataFrame, knowledge: Knowledge, manual: bool = False, compat: bool = True) -> DataFrame:
    """Emails with status, collection, query text and the ``outcome`` known before any search.

    The outcome is NULL where a search is due; ``error`` holds the text of a failed check.
    """
    resolved = tickets.resolve_tickets(emails, ticket_rows, knowledge.category_map, compat)
    named = tickets.name_collection(resolved, knowledge.category_map, manual)
    checked = search.with_schema(named, knowledge.fields, ["src_order"])
    collection, status, fields = F.col("collection"), F.col("status"), F.col("fields")
    body = body_or_subject(F.col("subject"), F.col("email_body")) if manual else F.col("email_body")
    settled = (
        F.when(F.col("matched_by") == "none", "not_found")
        .when(F.col("skipped"), "skipped")
        .when(collection == "", "empty_category")
        .when(fields.isNull() | ~F.array_contains(fields, status), "fallback")
        .when(F.col("query_text").isNull(), "no_query_text")
    )
    failed = F.coalesce(
        search.missing_collection_error(collection, fields), search.missing_field_error(collection, status, fields)
    )
    return (
        checked.withColumn("query_text", query_text(F.col("subject"), body))
        .withColumn("outcome", settled)
        .withColumn("error", F.when(F.col("outcome").isin("fallback", "not_found"), failed))
        .drop("fields", "skipped")
    )


def find_answers(asked: DataFrame, knowledge: Knowledge, embed: Embedder = embed_hashed) -> DataFrame:
    """Best row for every distinct (collection, text) of ``asked``, with the cells the askers' statuses name.

    Returns collection, text_id, kb_id, score, hit_subject, hit_body, responses (map).
    """
    # Equal texts are searched once. The status set is as long as a sheet is wide.
    texts = materialise(
        asked.groupBy("collection", "text_id").agg(
            F.first("query_text").alias("query_text"), F.collect_set("status").alias("statuses")
        ),
        "texts",
    )
    queries = texts.select("collection", F.col("text_id").alias("query_id"), "query_text")
    if knowledge.vectors is not None:
        queries = with_stored_vectors(queries, "query_text", knowledge.vectors, ["query_id"], embed)
    else:
        queries = embed(queries, "query_text", "vector")
    hits = best_rows(queries.drop("query_text"), knowledge, embed).select(
        "collection", F.col("query_id").alias("text_id"), "kb_id", "score"
    )
    # The search is the dearest step: written, so that nothing after it can run it again.
    wanted = materialise(hits.join(texts.select("collection", "text_id", "statuses"), ["collection", "text_id"]), "hits")
    cells = knowledge.rows.select(
        "collection", "kb_id", F.col("subject").alias("hit_subject"), F.col("email_body").alias("hit_body"), "fields"
    )
    # Many texts may hit one row, so the popular rows are salted where this is a shuffle.
    found = fetch_rows(wanted, in_named_partitions(cells, wanted, "collection"), ["collection", "kb_id"], ["text_id"])
    responses = F.map_filter("fields", lambda name, _: F.array_contains("statuses", name))
    return found.withColumn("responses", responses).drop("fields", "statuses")


def write_replies(answered: DataFrame, generator: Callable | None = None, **generation) -> DataFrame:
    """Result rows. Without ``generator`` the reply is the canned response, template or fixed text itself."""
    outcome, collection = F.col("outcome"), F.col("collection")
    canned = (
        F.when(outcome == "search", F.coalesce(F.nullif(F.col("response"), F.lit("")), F.lit(replies.GENERIC_REPLY)))
        .when(outcome == "template_fallback", F.col("html"))
        .when(outcome == "skipped", F.concat(F.lit("Skipped search for category: "), collection))
        .when(outcome == "empty_category", "Failed at category check: Category is empty. Cannot run search.")
        .when(outcome == "no_query_text", "At least one of subject or body must be provided.")
        .otherwise(replies.GENERIC_REPLY)
    )
    if generator is not None:
        base = {"subject": F.col("hit_subject"), "email_body": F.col("hit_body")}
        shown = F.map_from_arrays(
            F.array(*map(F.lit, base)), F.array(*[F.coalesce(c, F.lit("")) for c in base.values()])
        )
        own = F.map_from_arrays(F.array("status"), F.array(F.coalesce("response", F.lit(""))))
        fields = F.when(F.col("status").isin(*base), shown).otherwise(F.map_concat(shown, own))
        result = F.struct(F.lit("").alias("status"), fields.alias("fields"))
        metadata = F.struct(collection, F.lit(None).cast("string").alias("status_field"), F.lit(1).alias("results_count"))
        prompt = F.when(
            outcome == "search", replies.search_prompt(replies.knowledge_context(metadata, F.array(result)))
        ).when(outcome == "template_fallback", replies.template_prompt(F.col("html")))
        asked = replies.generate(answered.withColumn("prompt", prompt), generator, ["src_order"], **generation)
        failed = F.col("generation_error").isNotNull()
        answered = asked.withColumn("outcome", F.when(failed, "error").otherwise(outcome)).withColumn(
            "error", F.coalesce("generation_error", "error")
        )
        canned = (
            F.when(failed, F.concat(F.lit("Error: "), F.col("generation_error")))
            .when(F.col("prompt").isNotNull(), replies.clean_reply(F.coalesce("generated", F.lit(""))))
            .otherwise(canned)
        )
    return (
        answered.withColumn("response_generated", canned)
        .withColumn("template_referred", replies.route_label(F.col("outcome")))
        .select(*RESULT_COLUMNS)
    )


def reply_to_batch(
    emails: DataFrame,
    ticket_rows: DataFrame,
    knowledge: Knowledge,
    embed: Embedder = embed_hashed,
    generator: Callable | None = None,
    manual: bool = False,
    escape: bool = False,
    compat: bool = True,
    **generation,
) -> DataFrame:
    """One result row for every email.

    ``emails``: ticket, src_order (unique), subject, email_body.
    """
    if escape:
        emails = emails.withColumns({c: escape_text(F.col(c)) for c in ("subject", "email_body")})
    routed = materialise(
        route(emails, ticket_rows, knowledge, manual, compat).withColumn("text_id", F.sha2("query_text", 256)), "routed"
    )
    answers = find_answers(
        routed.where(F.col("outcome").isNull()).select("collection", "text_id", "query_text", "status"), knowledge, embed
    )
    # Only rows that were searched carry a key, so the others cannot gather in one task.
    keyed = routed.withColumn("text_id", F.when(F.col("outcome").isNull(), F.col("text_id"))).drop("query_text")
    joined = salted_left_join(keyed, answers, ["collection", "text_id"], ["src_order"])
    missed = F.col("outcome").isNull() & F.col("kb_id").isNull()
    answered = joined.withColumn(
        "error", F.when(missed, search.no_match_error(F.col("collection"), F.col("status"))).otherwise(F.col("error"))
    ).withColumn(
        "response",
        search.named_cell(
            F.col("status"), F.col("responses"), F.col("hit_subject"), F.col("hit_body"), F.col("kb_id")
        ),
    )
    # A missing field names its collection and gets that template; every other failure is generic.
    template_due = replies.collection_from_error(F.col("error")).isNotNull() & (F.col("outcome") == "fallback")
    with_html = replies.attach_templates(answered, knowledge.templates, template_due, ["src_order"])
    final = (
        F.when(F.col("kb_id").isNotNull(), "search")
        .when(F.col("outcome").isNull(), "generic_fallback")
        .when((F.col("outcome") == "fallback") & F.col("html").isNotNull(), "template_fallback")
        .when(F.col("outcome") == "fallback", "generic_fallback")
        .otherwise(F.col("outcome"))
    )
    return write_replies(with_html.withColumn("outcome", final), generator, **generation)


def not_done(emails: DataFrame, earlier: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Emails whose ticket has no result row yet; with ``retry_errors`` failed ones count as open.

    A missing ticket id is an id like any other: emails without one are done once a result without one is there.
    Where ``earlier`` has a ``ticket_key`` it is taken for a table that ``append_bucketed`` wrote: the tickets
    asked for, each once, go to its buckets, and its rows stay where they lie.
    """
    done = earlier.where(F.col("outcome") != "error") if retry_errors else earlier
    keyed = emails.withColumn("ticket_key", ticket_key(F.col("ticket")))
    if "ticket_key" in earlier.columns:
        tickets_asked = keyed.select("ticket_key").distinct()
        fresh = tickets_asked.join(done.select("ticket_key").hint("merge"), "ticket_key", "left_anti").withColumn("_open", F.lit(True))
        return lookup_join(keyed, fresh, ["ticket_key"], ["src_order"]).where("_open").select(*emails.columns)
    named = done.withColumn("ticket_key", ticket_key(F.col("ticket")))
    return salted_anti_join(keyed, named, ["ticket_key"], ["src_order"]).select(*emails.columns)


def append_results(earlier: DataFrame, new: DataFrame) -> DataFrame:
    return earlier.unionByName(new, allowMissingColumns=True)


def label_missing(results: DataFrame) -> DataFrame:
    return results.fillna("unknown", ["template_referred"])


def reply_to_ticket(spark, ticket: str, subject: str, email_body: str | None, ticket_rows: DataFrame, knowledge: Knowledge, **options) -> DataFrame:
    """The same flow for one email, by the single-ticket naming rules."""
    one = spark.createDataFrame(
        [(ticket, 0, subject, email_body)], "ticket string, src_order long, subject string, email_body string"
    )
    return reply_to_batch(one, ticket_rows, knowledge, manual=True, **options)
