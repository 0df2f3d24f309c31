"""Registered queries: similarity search, its checks, metadata filters and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyforge.functions import text as tx
from replyforge.functions import vectors as vec
from replyforge.operators import catalog, cells, filters, joins, search, tickets
from replyforge.plans.batch import embed_rows
from replyforge.plans.fixtures import ALL_STATUS_FIELDS
from replyforge.plans.queries_tickets import Q9_SQL
from replyforge.plans.registry import (
    CLASSIFIED,
    KB_EMBEDDED,
    RESOLVED,
    over,
    query,
    sql_embedding,
    sql_hits,
    sql_query_text,
    sql_strip,
)
from replyforge.session import materialise, scratch_path
from replyforge.sources import writers

C = F.col

# --- search ---------------------------------------------------------------------------


def _vector_sides(fx):
    kb = fx.vectors.withColumnRenamed("embedding", "vector")
    return kb.withColumnRenamed("kb_id", "query_id"), kb


def _vector_hits_sql(k: int) -> str:
    return (
        over("fx_vectors")
        + f"""SELECT collection, query_id, kb_id, score, rank FROM (
             SELECT *, CAST(row_number() OVER (PARTITION BY collection, query_id ORDER BY score DESC, kb_id) AS INT) AS rank
             FROM (SELECT q.collection, q.kb_id AS query_id, k.kb_id,
                     round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS score
                   FROM fx_vectors q JOIN fx_vectors k ON k.collection = q.collection) s) t WHERE rank <= {k}"""
    )


@query("k1_topk_cosine", _vector_hits_sql(10))
def k1(fx):
    queries, kb = _vector_sides(fx)
    return search.exact_topk(queries, kb, 10)


@query("k1_topk_blocks", _vector_hits_sql(10))
def k1_blocks(fx):
    """The full search of two large sides, forced by small blocks: rows in cells, cells skipped by the angle bound."""
    queries, kb = _vector_sides(fx)
    return search.exact_topk(queries, kb, 10, block_rows=64)


def _stored_index(fx, kb):
    """The index of every collection, built once, stored and read back."""
    path = scratch_path(fx.spark, "index")
    cells.save_index(cells.build_index(kb), path)
    return cells.load_index(fx.spark, path)


@query("k2_cells_exact", _vector_hits_sql(10))
def k2_exact(fx):
    """The measured number of cells first, then every cell the bound leaves open: the full answer."""
    queries, kb = _vector_sides(fx)
    return cells.cell_topk(queries, cells.build_index(kb), 10, exact=True)


@query("k2_cells_nprobe", _vector_hits_sql(10))
def k2_nprobe(fx):
    """All cells of every collection probed, from a stored index: the full answer."""
    queries, kb = _vector_sides(fx)
    return cells.cell_topk(queries, _stored_index(fx, kb), 10, nprobe=cells.MOST_CELLS)


@query(
    "k2_cells_recall",
    over("fx_vectors") + "SELECT collection, count(*) AS queries, CAST(sum(least(10, n)) AS BIGINT) AS wanted, TRUE AS enough FROM (SELECT *, count(*) OVER (PARTITION BY collection) AS n FROM fx_vectors) t GROUP BY collection",
)
def k2_recall(fx):
    """The approximate answer at the measured number of cells holds nine tenths of the full one in every collection."""
    queries, kb = _vector_sides(fx)
    found = cells.cell_topk(queries, _stored_index(fx, kb), 10).select("collection", "query_id", "kb_id", F.lit(1).alias("got"))
    wanted = search.exact_topk(queries, kb, 10).select("collection", "query_id", "kb_id")
    both = wanted.join(found, ["collection", "query_id", "kb_id"], "left")
    enough = F.sum(F.coalesce("got", F.lit(0))) >= 0.9 * F.count(F.lit(1))
    return both.groupBy("collection").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), enough.alias("enough")
    )


@query("k4_rank", _vector_hits_sql(3).replace("SELECT collection, query_id, kb_id, score, rank", "SELECT query_id, kb_id, rank", 1))
def k4(fx):
    queries, kb = _vector_sides(fx)
    return search.exact_topk(queries, kb, 3).select("query_id", "kb_id", "rank")


def _named(fx):
    """Emails with the status and collection of their ticket."""
    resolved = tickets.resolve_tickets(fx.emails, fx.tickets, fx.category_map)
    return tickets.name_collection(resolved, fx.category_map)


def _search(fx, asked, k: int):
    """Best rows for every text of ``asked`` (collection, query_id, text)."""
    # Written once: the search counts the queries before it places them.
    queries = materialise(vec.embed_hashed(asked, "text", "vector").drop("text"), "queries")
    return search.exact_topk(queries, embed_rows(fx.kb_spread), k)


def _text_hits(fx, text, k: int):
    """Best rows for ``text`` of every email: collection, query_id (src_order), kb_id, score, rank."""
    return _search(fx, _named(fx).select("collection", C("src_order").alias("query_id"), text.alias("text")), k)


BOTH_TEXTS = sql_query_text("subject", "email_body")


def _text_hits_sql(text: str, k: int) -> str:
    asked = f"asked AS (SELECT src_order, collection, status, subject, email_body, {text} AS text FROM named)"
    return over("fx_tickets fx_category_map fx_emails fx_kb fx_fields", *RESOLVED, asked, *KB_EMBEDDED, *sql_hits("asked", "text", k))


@query(
    "k1_topk_text",
    _text_hits_sql(BOTH_TEXTS, 3) + "SELECT collection, src_order AS query_id, kb_id, score, rank FROM hits",
)
def k1_text(fx):
    return _text_hits(fx, tx.query_text(C("subject"), C("email_body")), 3)


@query(
    "k3_subject_search",
    _text_hits_sql("subject", 3) + "SELECT collection, src_order AS query_id, kb_id, score, rank FROM hits",
)
def k3(fx):
    return _text_hits(fx, C("subject"), 3)


def _asked(fx):
    """Emails with status and collection, written: the search, its checks and its output all read them."""
    named = _named(fx).select(
        C("src_order").alias("query_id"), "collection", "status", C("subject").alias("query_subject"), C("email_body").alias("query_body")
    )
    return materialise(named, "named")


def _projected(fx, k: int, asked=None):
    """Hits with subject, body and the cell of the column the email's status names."""
    asked = _asked(fx) if asked is None else asked
    text = tx.query_text(C("query_subject"), C("query_body"))
    # Written, since the checks and joins after it would run the search again.
    hits = materialise(_search(fx, asked.select("collection", "query_id", text.alias("text")), k), "hits")
    found = joins.fetch_rows(hits, fx.kb_rows, ["collection", "kb_id"], ["query_id", "rank"])
    cell = F.try_element_at("fields", C("status"))
    return found.join(asked.drop("collection"), "query_id").withColumn("response", cell)


PROJECTED_SQL = f"""responses AS ({Q9_SQL}), projected AS (
    SELECT h.src_order AS query_id, h.rank, h.collection, h.kb_id, h.score, k.subject, k.email_body, a.status, r.response,
           a.subject AS query_subject, a.email_body AS query_body
    FROM hits h JOIN asked a ON a.src_order = h.src_order JOIN fx_kb k ON k.kb_id = h.kb_id
    LEFT JOIN fx_fields f ON f.collection = h.collection AND f.field = a.status
    LEFT JOIN responses r ON r.kb_id = h.kb_id AND r.field = f.field)"""


@query(
    "k5_output_fields",
    _text_hits_sql(BOTH_TEXTS, 2) + f", {PROJECTED_SQL} SELECT query_id, rank, subject, email_body, status, response FROM projected",
)
def k5(fx):
    return _projected(fx, 2).select("query_id", "rank", "subject", "email_body", "status", "response")


def _checked(fx):
    return search.with_schema(_named(fx).select("src_order", "collection", "status"), fx.fields, ["src_order"])


SCHEMAS_SQL = """schemas AS (SELECT collection, '[' || string_agg('''' || field || '''', ', ' ORDER BY ordinal) || ']' AS fields
    FROM fx_fields GROUP BY ALL)"""
RESOLVED_VIEWS = "fx_tickets fx_category_map fx_emails fx_fields"
ERRORS_SQL = """failed AS (SELECT n.src_order, n.collection, n.status, CASE
       WHEN s.collection IS NULL THEN 'Collection ''' || n.collection || ''' not found.'
       WHEN f.field IS NULL THEN 'Field ''' || n.status || ''' not found in collection ''' || n.collection ||
            '''. Available fields: ' || s.fields END AS error, f.field IS NULL AND s.collection IS NOT NULL AS no_field
     FROM named n LEFT JOIN schemas s ON s.collection = n.collection
     LEFT JOIN fx_fields f ON f.collection = n.collection AND f.field = n.status)"""
# Every email with what its checks and its search say.
CHECKED_SQL = f"""{SCHEMAS_SQL}, {ERRORS_SQL}, {PROJECTED_SQL}, checked AS (
    SELECT a.src_order AS query_id, a.collection, a.status AS status_field, a.subject AS query_subject, a.email_body AS query_body,
           p.rank, p.kb_id, p.score, p.response, coalesce(x.error, CASE WHEN p.rank IS NULL THEN
             'No matching records found in collection ''' || a.collection || ''' for field ''' || a.status || '''.' END) AS error
    FROM asked a JOIN failed x ON x.src_order = a.src_order
    LEFT JOIN projected p ON p.query_id = a.src_order AND x.error IS NULL)"""


@query(
    "k6_missing_collection",
    over(RESOLVED_VIEWS, *RESOLVED)
    + """SELECT src_order, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_fields f WHERE f.collection = n.collection)
           THEN 'Collection ''' || collection || ''' not found.' END AS error FROM named n""",
)
def k6(fx):
    return _checked(fx).select("src_order", search.missing_collection_error(C("collection"), C("fields")).alias("error"))


@query(
    "k7_missing_field",
    over(RESOLVED_VIEWS, *RESOLVED, SCHEMAS_SQL)
    + """SELECT n.src_order, CASE WHEN f.field IS NULL THEN 'Field ''' || n.status || ''' not found in collection ''' ||
              n.collection || '''. Available fields: ' || s.fields END AS error
         FROM named n LEFT JOIN schemas s ON s.collection = n.collection
         LEFT JOIN fx_fields f ON f.collection = n.collection AND f.field = n.status""",
)
def k7(fx):
    error = search.missing_field_error(C("collection"), C("status"), C("fields"))
    return _checked(fx).select("src_order", error.alias("error"))


@query(
    "k8_no_match",
    over("fx_kb " + RESOLVED_VIEWS, *RESOLVED)
    + """SELECT src_order, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_kb k WHERE k.collection = n.collection)
           THEN 'No matching records found in collection ''' || collection || ''' for field ''' || status || '''.' END AS error
         FROM named n""",
)
def k8(fx):
    asked = _named(fx).select("src_order", "collection", "status")
    counted = joins.lookup_join(asked, catalog.collection_counts(fx.kb), ["collection"], ["src_order"])
    error = F.when(C("rows").isNull(), search.no_match_error(C("collection"), C("status")))
    return counted.select("src_order", error.alias("error"))


@query(
    "k9_fuzzy_field",
    over("fx_tickets fx_category_map fx_fields", *CLASSIFIED)
    + """, wanted AS (SELECT src_order, category AS collection, CASE src_order % 4 WHEN 0 THEN upper(status) WHEN 1 THEN status
              WHEN 2 THEN substr(status, 1, 9) ELSE '' END AS wanted FROM classified),
       rated AS (SELECT w.*, f.field, f.ordinal, CASE WHEN f.field = w.wanted THEN 1
              WHEN lower(f.field) = lower(w.wanted) THEN 2
              WHEN contains(lower(f.field), lower(w.wanted)) OR contains(lower(w.wanted), lower(f.field)) THEN 3 END AS grade
            FROM wanted w LEFT JOIN fx_fields f ON f.collection = w.collection)
       SELECT src_order, wanted, CASE WHEN wanted <> '' THEN
              arg_min(field, grade * 1000 + ordinal) FILTER (WHERE grade IS NOT NULL) END AS field
       FROM rated GROUP BY src_order, wanted""",
)
def k9(fx):
    status, turn = C("status"), C("src_order") % 4
    wanted = (
        F.when(turn == 0, F.upper(status)).when(turn == 1, status).when(turn == 2, F.substring(status, 1, 9)).otherwise("")
    )
    asked = tickets.classify(fx.tickets, fx.category_map).select(
        "src_order", C("category").alias("collection"), wanted.alias("wanted")
    )
    with_fields = search.with_schema(asked, fx.fields, ["src_order"])
    return with_fields.select("src_order", "wanted", search.resolve_field(C("wanted"), C("fields")).alias("field"))


RUN_AT = "2025-01-31T12:00:00"


def _envelopes(fx, k: int):
    """An envelope for every email, with the error where a check fails or nothing matches."""
    asked = _asked(fx)
    error = F.coalesce(
        search.missing_collection_error(C("collection"), C("fields")),
        search.missing_field_error(C("collection"), C("status"), C("fields")),
    )
    checked = search.with_schema(asked, fx.fields, ["query_id"]).select(
        "query_id", "collection", "query_subject", "query_body", C("status").alias("status_field"), F.lit(k).alias("top_k"), error.alias("error")
    )
    # A column of its own: beside an alias "status" a lambda would read the alias.
    hits = _projected(fx, k, asked).withColumn("own", F.map_filter("fields", lambda name, _: name == C("status")))
    shown = F.map_concat(
        F.create_map(F.lit("subject"), F.coalesce("subject", F.lit("")), F.lit("email_body"), F.coalesce("email_body", F.lit(""))),
        "own",
    )
    found = hits.select(
        "query_id", "rank", C("kb_id").cast("string").alias("id"), C("score").alias("distance"),
        C("response").alias("status"), shown.alias("fields"),
    )
    return search.envelopes(checked, found, F.lit(RUN_AT))


@query(
    "k10_envelope",
    _text_hits_sql(BOTH_TEXTS, 3)
    + f""", {CHECKED_SQL} SELECT query_id, collection, status_field, 3 AS top_k, '2025-01-31T12:00:00' AS timestamp, error,
           CAST(count(rank) AS INT) AS results_count,
           coalesce(string_agg(rank || ':' || kb_id || ':' || coalesce(response, '-'), ';' ORDER BY rank), '') AS results
         FROM checked GROUP BY query_id, collection, status_field, error""",
)
def k10(fx):
    line = F.transform(
        "results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["id"], F.coalesce(r["status"], F.lit("-")))
    )
    return _envelopes(fx, 3).select(
        "query_id", "metadata.collection", "metadata.status_field", "metadata.top_k", "metadata.timestamp", "error",
        "metadata.results_count", F.coalesce(F.array_join(line, ";"), F.lit("")).alias("results"),
    )


@query(
    "k11_blank_hit",
    over("fx_kb")
    + """SELECT kb_id, CASE WHEN kb_id % 2 = 0 AND trim(coalesce(email_body, '')) = ''
           THEN 'Subject and email body are empty for this result.' END AS message FROM fx_kb""",
)
def k11(fx):
    subject = F.when(C("kb_id") % 2 == 0, " ").otherwise(C("subject"))
    return fx.kb.select("kb_id", search.blank_hit_message(subject, C("email_body")).alias("message"))


@query(
    "k12_top_status",
    _text_hits_sql(BOTH_TEXTS, 2) + f", {PROJECTED_SQL} SELECT query_id, nullif(response, '') AS status FROM projected WHERE rank = 1",
)
def k12(fx):
    hits = _projected(fx, 2).drop("status").withColumnRenamed("response", "status")
    return search.top_status(hits)


@query(
    "k13_degraded_sample",
    over("fx_kb " + RESOLVED_VIEWS, *RESOLVED, f"responses AS ({Q9_SQL})", "firsts AS (SELECT collection, min(kb_id) AS kb_id FROM fx_kb GROUP BY ALL)")
    + """SELECT n.src_order AS query_id, r.response AS status FROM named n LEFT JOIN firsts k ON k.collection = n.collection
         LEFT JOIN fx_fields f ON f.collection = n.collection AND f.field = n.status
         LEFT JOIN responses r ON r.kb_id = k.kb_id AND r.field = f.field""",
)
def k13(fx):
    """What every email would get if its search failed."""
    failed = _named(fx).select(C("src_order").alias("query_id"), "collection", C("status").alias("status_field"))
    return search.degraded_status(failed, fx.kb_rows)


# --- metadata filters -----------------------------------------------------------------


@query(
    "f1_equal_rows",
    over("fx_tickets")
    + """SELECT ticket, src_order, loan_status, repayment_status FROM fx_tickets
         WHERE loan_status = 'CLOSED' AND repayment_status = 'REGULAR' ORDER BY src_order LIMIT 10""",
)
def f1(fx):
    columns = fx.tickets.select("ticket", "src_order", "loan_status", "repayment_status")
    return filters.equal_rows(columns, {"loan_status": "CLOSED", "repayment_status": "REGULAR"}, ["src_order"])


@query(
    "f2_field_by_pattern",
    over("fx_fields")
    + "SELECT collection, arg_min(field, ordinal) AS field FROM fx_fields WHERE contains(lower(field), 'closed') GROUP BY ALL",
)
def f2(fx):
    return filters.field_by_pattern(fx.fields, "Closed")


@query(
    "f3_query_check",
    over("fx_emails fx_tickets")
    + """, asked AS (SELECT e.src_order, e.subject, t.loan_status FROM fx_emails e LEFT JOIN fx_tickets t ON t.ticket = e.ticket)
       SELECT src_order, 'subject == "' || subject || '" and status == "' || loan_status || '"' AS expression,
         CASE WHEN coalesce(subject, '') = '' OR coalesce(loan_status, '') = '' THEN 'no_input'
              WHEN contains('subject == "' || subject || '" and status == "' || loan_status || '"', 'None') THEN 'none_value'
              ELSE 'ok' END AS outcome FROM asked""",
)
def f3(fx):
    index = tickets.first_per_ticket(fx.tickets, ["loan_status"])
    asked = joins.salted_left_join(fx.emails.select("ticket", "src_order", "subject"), index, ["ticket"], ["src_order"])
    expression = filters.equality_expression(F.lit("subject"), C("subject"), F.lit("status"), C("loan_status"))
    return asked.select(
        "src_order", expression.alias("expression"),
        filters.query_check(C("subject"), C("loan_status"), expression).alias("outcome"),
    )


@query("f4_contains", over("fx_kb") + "SELECT collection, kb_id, subject FROM fx_kb WHERE contains(subject, 'Entry 12')")
def f4(fx):
    return fx.kb.select("collection", "kb_id", "subject").where(filters.any_contains([C("subject")], "Entry 12"))


@query(
    "f5_any_contains",
    over("fx_kb")
    + "SELECT collection, kb_id FROM fx_kb WHERE "
    + " OR ".join(f"coalesce(contains({c}, '99'), FALSE)" for c in ["subject", "email_body", *ALL_STATUS_FIELDS]),
)
def f5(fx):
    columns = [C(c) for c in ["subject", "email_body", *ALL_STATUS_FIELDS]]
    return fx.kb.where(filters.any_contains(columns, "99")).select("collection", "kb_id")


@query(
    "f5_any_cell_contains",
    over("fx_kb fx_fields", f"responses AS ({Q9_SQL})")
    + """SELECT DISTINCT r.collection, r.kb_id FROM responses r
         JOIN fx_fields f ON f.collection = r.collection AND f.field = r.field WHERE contains(r.response, 'closed 9')""",
)
def f5_cells(fx):
    return fx.kb_rows.where(filters.any_cell_contains(C("fields"), "closed 9")).select("collection", "kb_id")


@query(
    "f6_field_roles",
    over("fx_fields")
    + """SELECT collection,
           arg_min(field, ordinal) FILTER (WHERE regexp_matches(lower(field), 'subject|title|query')) AS subject_field,
           arg_min(field, ordinal) FILTER (WHERE regexp_matches(lower(field), 'body|content|text|message|email')) AS body_field
         FROM fx_fields GROUP BY ALL""",
)
def f6(fx):
    return filters.field_roles(fx.fields)


@query(
    "f7_filtered_search",
    over("fx_kb", *KB_EMBEDDED)
    + """, scored AS (SELECT k.collection, k.kb_id, round(coalesce(sum(v.w * v.w), 0), 6) AS score
           FROM fx_kb k LEFT JOIN kb_vec v ON v.kb_id = k.kb_id WHERE contains(k.subject, '2') GROUP BY ALL)
       SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY collection ORDER BY score, kb_id) AS INT) AS rank
         FROM scored) t WHERE rank <= 5""",
)
def f7(fx):
    matching = fx.kb.where(filters.any_contains([C("subject")], "2"))
    return filters.filtered_search(embed_rows(matching), F.lit(True))


@query("f8_id_range", over("fx_kb") + "SELECT kb_id, subject FROM fx_kb WHERE kb_id >= 1 ORDER BY kb_id LIMIT 3 OFFSET 2")
def f8(fx):
    return filters.id_range(fx.kb.select("kb_id", "subject"), 1, 3, offset=2)


@query("f9_ids_in", over("fx_kb") + "SELECT kb_id, subject FROM fx_kb WHERE kb_id IN (1, 10)")
def f9(fx):
    return filters.ids_in(fx.kb.select("kb_id", "subject"), [1, 10])


# Fixed values, written out again to check the ones in use.
SKIPPED = [
    "post_loan_disbursal_query_payment_lndn_payment_",
    "predisbursal_loan_query_rf/vf_query_general_information",
    "escalations_rbi-cyber_cell_",
    "escalations_singledebt_",
    "post_loan_disbursal_query_payment_paytm_payment_not_updated",
    "other_kyc_issues",
    "predisbursal_loan_query_im+_instances_unable_to_place_withdrawal",
]
SKIP_LIST = ", ".join(f"'{c}'" for c in SKIPPED)


@query(
    "f10_skip_list",
    over("fx_tickets")
    + f"""SELECT src_order, list_extract([{SKIP_LIST}], CAST(src_order % 9 AS INT) + 1) AS category FROM fx_tickets
          WHERE src_order % 9 < {len(SKIPPED)}""",
)
def f10(fx):
    """Every skipped category, an ordinary one and a missing one."""
    words = F.array(*map(F.lit, [*SKIPPED, "collection_query"]))
    named = fx.tickets.select("src_order", F.get(words, C("src_order") % 9).alias("category"))
    return named.where(filters.category_gate(C("category")) == "skipped")


@query(
    "f11_category_gate",
    over("fx_tickets fx_category_map", *CLASSIFIED)
    + f"""SELECT src_order, CASE WHEN category IN ({SKIP_LIST}) THEN 'skipped' WHEN category = '' THEN 'empty_category'
           ELSE 'search' END AS gate FROM classified""",
)
def f11(fx):
    known = tickets.classify(fx.tickets, fx.category_map)
    return known.select("src_order", filters.category_gate(C("category")).alias("gate"))


@query("f12_head", over("fx_emails") + "SELECT ticket, src_order FROM fx_emails ORDER BY src_order LIMIT 100")
def f12(fx):
    return filters.first_rows(fx.emails.select("ticket", "src_order"), ["src_order"], 100)


@query("f13_text_columns", "SELECT label FROM embeddings")
def f13(fx):
    return filters.text_fields(fx.table("embeddings").withColumnRenamed("vec_id", "id"))


# --- catalog --------------------------------------------------------------------------


@query(
    "c1_list_collections",
    over("fx_kb") + "SELECT row_number() OVER (ORDER BY collection) AS number, collection FROM (SELECT DISTINCT collection FROM fx_kb)",
)
def c1(fx):
    return catalog.list_collections(fx.kb)


@query("c2_row_counts", over("fx_kb") + 'SELECT collection, count(*) AS "rows" FROM fx_kb GROUP BY ALL')
def c2(fx):
    return catalog.collection_counts(fx.kb)


@query(
    "c3_describe_fields",
    over("fx_fields")
    + """SELECT collection, ordinal, field, CASE field WHEN 'id' THEN 'INT64' WHEN 'embedding' THEN 'FLOAT_VECTOR' ELSE 'VARCHAR' END AS type,
           field = 'id' AS is_primary, field = 'id' AS auto_id, '' AS description,
           CASE field WHEN 'id' THEN '' WHEN 'embedding' THEN 'dim=384' ELSE 'max_length=65535' END AS params FROM fx_fields""",
)
def c3(fx):
    return catalog.describe_fields(fx.fields)


@query(
    "c4_searchable_fields",
    over("fx_fields") + "SELECT collection, field, ordinal FROM fx_fields WHERE field NOT IN ('id', 'embedding')",
)
def c4(fx):
    return catalog.searchable_fields(fx.fields)


@query(
    "c5_fields_text",
    over("fx_fields")
    + """SELECT collection, string_agg(field, ', ' ORDER BY ordinal) AS fields FROM fx_fields
         WHERE field NOT IN ('subject', 'email_body') GROUP BY ALL""",
)
def c5(fx):
    return catalog.fields_text(fx.fields)


@query(
    "c6_sample_rows",
    over("fx_kb", *KB_EMBEDDED)
    + """SELECT collection, kb_id, CAST(rn AS INT) AS sample,
           CASE WHEN length(email_body) > 100 THEN substring(email_body, 1, 100) || '... [truncated]' ELSE email_body END AS email_body,
           '[Vector with 384 dimensions]' AS vector
         FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY kb_id) AS rn FROM fx_kb) t WHERE rn <= 2""",
)
def c6(fx):
    sample = catalog.sample_rows(fx.kb.select("collection", "kb_id", "subject", "email_body"), 2)
    text = tx.kb_text(C("subject"), C("email_body"))
    with_vector = vec.embed_hashed(sample.withColumn("text", text), "text", "vector")
    displayed = catalog.shown(with_vector, ["email_body"]).withColumn("vector", catalog.shown_vector(C("vector")))
    return displayed.select("collection", "kb_id", "sample", "email_body", "vector")


@query("c7_partition_counts", 'SELECT source AS collection, lang, count(*) AS "rows" FROM documents GROUP BY ALL')
def c7(fx):
    return catalog.collection_counts(fx.table("documents").withColumnRenamed("source", "collection"), ["collection", "lang"])


@query(
    "c8_verify_ingest",
    over("fx_kb")
    + """SELECT collection, count(*) AS expected, count(*) FILTER (WHERE kb_id % 10 <> 3) AS stored,
           count(*) FILTER (WHERE kb_id % 10 = 3) = 0 AS complete FROM fx_kb GROUP BY ALL""",
)
def c8(fx):
    path = scratch_path(fx.spark, "kb")
    arrived = fx.kb.where(C("kb_id") % 10 != 3)
    writers.write_collections(arrived.select("kb_id", "subject", "email_body", "collection"), path)
    delivered = catalog.collection_counts(fx.kb).withColumnRenamed("rows", "expected")
    return catalog.verify_ingest(fx.spark.read.parquet(path), delivered)


@query(
    "c8_record_structure",
    over("fx_kb fx_fields", f"responses AS ({Q9_SQL})")
    + """, firsts AS (SELECT collection, min(kb_id) AS kb_id FROM fx_kb GROUP BY ALL),
         cells AS (SELECT collection, kb_id, 'kb_id' AS field, CAST(kb_id AS VARCHAR) AS value FROM fx_kb
           UNION ALL SELECT collection, kb_id, 'subject', subject FROM fx_kb
           UNION ALL SELECT collection, kb_id, 'email_body', email_body FROM fx_kb
           UNION ALL SELECT r.collection, r.kb_id, r.field, r.response FROM responses r
             JOIN fx_fields f ON f.collection = r.collection AND f.field = r.field)
       SELECT c.collection, c.field, CASE WHEN length(value) > 100 THEN substring(value, 1, 100) || '...' ELSE value END AS value
       FROM cells c JOIN firsts k ON k.collection = c.collection AND k.kb_id = c.kb_id""",
)
def c8_structure(fx):
    path = scratch_path(fx.spark, "kb")
    writers.write_collections(fx.kb_rows, path)
    stored = fx.spark.read.schema("kb_id bigint, subject string, email_body string, fields map<string, string>, collection string").parquet(path)
    return catalog.record_structure(stored)


@query(
    "v9_rescored_hits",
    _text_hits_sql(BOTH_TEXTS, 1)
    + f""", hit_text AS (SELECT h.src_order, {sql_strip("coalesce(k.subject, '') || ' ' || coalesce(k.email_body, '')")} AS t
             FROM hits h JOIN fx_kb k ON k.kb_id = h.kb_id),
         {", ".join(sql_embedding("r_vec", "hit_text", "src_order", "t"))},
         sums AS (SELECT a.src_order, coalesce((SELECT sum(v.w * r.w) FROM q_vec v JOIN r_vec r ON r.bucket = v.bucket
                    AND r.src_order = v.src_order WHERE v.src_order = a.src_order), 0.0) AS d,
                  (SELECT sqrt(sum(w * w)) FROM q_vec v WHERE v.src_order = a.src_order) AS n,
                  (SELECT sqrt(sum(w * w)) FROM r_vec r WHERE r.src_order = a.src_order) AS m FROM hit_text a)
         SELECT src_order AS query_id, round(coalesce(d / (n * m), 0.0) * 100, 2) AS percent FROM sums""",
)
def v9(fx):
    hits = _projected(fx, 1)
    asked = tx.query_text(C("query_subject"), C("query_body"))
    texts = hits.select("query_id", asked.alias("asked"), tx.strip(tx.kb_text(C("subject"), C("email_body"))).alias("found"))
    vectors = vec.embed_hashed(vec.embed_hashed(texts, "asked", "a"), "found", "b")
    return vectors.select("query_id", vec.match_percent(vec.cosine(C("a"), C("b"))).alias("percent"))
