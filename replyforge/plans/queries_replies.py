"""Registered queries: routing, prompts, replies, batches, files."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from replyforge.functions import status as st
from replyforge.functions import text as tx
from replyforge.operators import catalog, replies, tickets
from replyforge.plans import batch
from replyforge.plans.queries_search import (
    BOTH_TEXTS,
    CHECKED_SQL,
    ERRORS_SQL,
    RESOLVED_VIEWS,
    SCHEMAS_SQL,
    SKIP_LIST,
    _checked,
    _envelopes,
    _text_hits_sql,
)
from replyforge.plans.queries_tickets import Q9_SQL, V3_BODY
from replyforge.plans.registry import (
    CLASSIFIED,
    KB_EMBEDDED,
    RESOLVED,
    over,
    query,
    sql_hits,
    sql_query_text,
)
from replyforge.session import materialise, scratch_path, spread_small
from replyforge.sources import readers, writers
from replyforge.operators.search import missing_collection_error, missing_field_error

C = F.col


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- routing --------------------------------------------------------------------------

FAILED = over(RESOLVED_VIEWS, *RESOLVED, SCHEMAS_SQL, ERRORS_SQL)


def _failed(fx):
    error = F.coalesce(
        missing_collection_error(C("collection"), C("fields")), missing_field_error(C("collection"), C("status"), C("fields"))
    )
    return _checked(fx).withColumn("error", error)


@query(
    "r1_collection_from_error",
    FAILED + "SELECT src_order, error, CASE WHEN no_field THEN collection END AS named FROM failed",
)
def r1(fx):
    return _failed(fx).select("src_order", "error", replies.collection_from_error(C("error")).alias("named"))


@query(
    "r2_reply_collection",
    FAILED + "SELECT src_order, CASE WHEN no_field THEN collection ELSE 'meta ' || collection END AS named FROM failed",
)
def r2(fx):
    named = replies.reply_collection(C("error"), F.concat(F.lit("meta "), C("collection")))
    return _failed(fx).select("src_order", named.alias("named"))


@query(
    "r3_no_results",
    FAILED + "SELECT src_order, error IS NOT NULL AS no_results FROM failed",
)
def r3(fx):
    results = F.when(C("error").isNull(), F.array(F.struct(F.lit(1).alias("rank"))))
    return _failed(fx).select("src_order", replies.no_results(results).alias("no_results"))


@query(
    "r4_template_fallback",
    over(RESOLVED_VIEWS + " fx_templates", *RESOLVED, SCHEMAS_SQL, ERRORS_SQL)
    + """SELECT src_order, f.collection, t.html FROM failed f
         LEFT JOIN fx_templates t ON f.no_field AND t.collection = f.collection""",
)
def r4(fx):
    failed = _failed(fx)
    due = replies.collection_from_error(C("error")).isNotNull()
    return replies.attach_templates(failed, fx.templates, due, ["src_order"]).select("src_order", "collection", "html")


# The whole batch in SQL: route, search, fallback, reply.
ROUTED_SQL = f"""routed AS (SELECT n.*, x.error AS failed_check, {{text}} AS text, CASE
       WHEN matched_by = 'none' THEN 'not_found'
       WHEN {{skip}} IN ({SKIP_LIST}) THEN 'skipped'
       WHEN n.collection = '' THEN 'empty_category'
       WHEN x.error IS NOT NULL THEN 'fallback'
       WHEN {{text}} IS NULL THEN 'no_query_text' END AS early
     FROM named n JOIN failed x ON x.src_order = n.src_order)"""
FINAL_SQL = f"""responses AS ({Q9_SQL}), final AS (
     SELECT r.ticket, r.src_order, r.subject, r.email_body, h.kb_id, h.score, r.collection, r.status,
       CASE WHEN h.kb_id IS NOT NULL THEN 'search' WHEN early = 'fallback' AND t.html IS NOT NULL THEN 'template_fallback'
            WHEN early = 'fallback' OR early IS NULL THEN 'generic_fallback' ELSE early END AS outcome,
       CASE WHEN early IN ('fallback', 'not_found') THEN failed_check
            WHEN early IS NULL AND h.kb_id IS NULL THEN 'No matching records found in collection ''' || r.collection ||
                 ''' for field ''' || r.status || '''.' END AS error,
       p.response, t.html, k.subject AS hit_subject, k.email_body AS hit_body
     FROM routed r LEFT JOIN hits h ON h.src_order = r.src_order LEFT JOIN fx_kb k ON k.kb_id = h.kb_id
     LEFT JOIN responses p ON p.kb_id = h.kb_id AND p.field = r.status
     LEFT JOIN fx_templates t ON early = 'fallback' AND starts_with(failed_check, 'Field') AND t.collection = r.collection),
   replied AS (SELECT *, CASE outcome
       WHEN 'search' THEN coalesce(nullif(response, ''), {sql_text(replies.GENERIC_REPLY)})
       WHEN 'template_fallback' THEN html
       WHEN 'skipped' THEN 'Skipped search for category: ' || collection
       WHEN 'empty_category' THEN 'Failed at category check: Category is empty. Cannot run search.'
       WHEN 'no_query_text' THEN 'At least one of subject or body must be provided.'
       ELSE {sql_text(replies.GENERIC_REPLY)} END AS response_generated,
     CASE WHEN outcome = 'search' THEN 'used search' WHEN outcome IN ('template_fallback', 'generic_fallback', 'not_found')
          THEN 'used fallback' WHEN outcome = 'no_query_text' THEN 'unknown' ELSE '' END AS template_referred FROM final)"""

# In the single-ticket path the category is mapped by its lower case and keeps its characters.
NAMED_MANUAL = """named AS (SELECT r.* REPLACE (CASE WHEN status = 'im_closed' THEN 'imclosed' ELSE status END AS status),
      coalesce(m.collection, category) AS collection
    FROM resolved r LEFT JOIN fx_category_map m ON m.raw = lower(category))"""


def batch_sql(manual: bool = False) -> str:
    text = sql_query_text("n.subject", V3_BODY.replace("email_body", "n.email_body").replace("subject", "n.subject") if manual else "n.email_body")
    routed = ROUTED_SQL.format(text=text, skip="n.collection" if manual else "n.category")
    resolved = (*RESOLVED[:-1], NAMED_MANUAL) if manual else RESOLVED
    asked = "asked AS (SELECT src_order, collection, text FROM routed WHERE early IS NULL)"
    return over(
        RESOLVED_VIEWS + " fx_kb fx_templates", *resolved, SCHEMAS_SQL, ERRORS_SQL, routed, asked, *KB_EMBEDDED,
        *sql_hits("asked", "text", 1), FINAL_SQL,
    )


RESULT_SQL = ", ".join(batch.RESULT_COLUMNS)


def knowledge(fx) -> batch.Knowledge:
    return batch.Knowledge(spread_small(fx.kb_rows, "kb_id"), fx.fields, fx.templates, fx.category_map)


@query("p1_batch_replies", batch_sql() + f"SELECT {RESULT_SQL} FROM replied")
def p1(fx):
    return batch.reply_to_batch(fx.emails, fx.tickets, knowledge(fx))


@query("p1_stored_vectors", batch_sql() + f"SELECT {RESULT_SQL} FROM replied")
def p1_stored(fx):
    """A second run of the batch: every text has its vector from the first one."""
    known = dataclasses.replace(knowledge(fx), vectors=scratch_path(fx.spark, "vectors"))
    materialise(batch.reply_to_batch(fx.emails, fx.tickets, known), "first-run")
    return batch.reply_to_batch(fx.emails, fx.tickets, known)


@query("p4_single_ticket_rules", batch_sql(manual=True) + f"SELECT {RESULT_SQL} FROM replied")
def p4(fx):
    """The single-ticket naming and text rules, for all emails at once."""
    return batch.reply_to_batch(fx.emails, fx.tickets, knowledge(fx), manual=True)


@query(
    "r5_generic_fallback",
    batch_sql()
    + """SELECT src_order, response_generated, CASE outcome WHEN 'template_fallback' THEN 'FALL BACK TEMPLATE USED (LLM)'
           ELSE 'GENERIC FALLBACK USED' END AS flag FROM replied WHERE template_referred = 'used fallback'""",
)
def r5(fx):
    results = batch.reply_to_batch(fx.emails, fx.tickets, knowledge(fx))
    fallback = results.where(C("template_referred") == "used fallback")
    return fallback.select("src_order", "response_generated", replies.fallback_flag(C("outcome")).alias("flag"))


@query("r6_route_label", batch_sql() + "SELECT outcome, template_referred, count(*) AS emails FROM replied GROUP BY ALL")
def r6(fx):
    results = batch.reply_to_batch(fx.emails, fx.tickets, knowledge(fx))
    return results.groupBy("outcome", "template_referred").agg(F.count(F.lit(1)).alias("emails"))


@query("r13_errors", batch_sql() + "SELECT error, count(*) AS emails FROM replied WHERE error IS NOT NULL GROUP BY ALL")
def r13(fx):
    results = batch.reply_to_batch(fx.emails, fx.tickets, knowledge(fx))
    return results.where(C("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("emails"))


# --- prompts and replies --------------------------------------------------------------


@query(
    "r7_knowledge_context",
    _text_hits_sql(BOTH_TEXTS, 4)
    + f""", {CHECKED_SQL}, parts AS (SELECT p.query_id, p.collection, p.status, p.rank, 'Result ' || p.rank || ':' || chr(10)
             || CASE WHEN coalesce(p.response, '') <> '' THEN '- Status: ' || p.response || chr(10) ELSE '' END
             || coalesce('- email_body: ' || nullif(email_body, '') || chr(10), '')
             || CASE WHEN coalesce(p.response, '') <> '' AND status < 'subject' THEN '- ' || status || ': ' || p.response || chr(10) ELSE '' END
             || '- subject: ' || subject || chr(10) || chr(10) AS part
             FROM projected p JOIN checked c ON c.query_id = p.query_id AND c.rank = p.rank)
         SELECT query_id, 'Here are the relevant details from our system:' || chr(10) || chr(10) || 'Search Context:' || chr(10)
           || '- Collection: ' || collection || chr(10) || '- Status Field: ' || status || chr(10)
           || '- Found ' || count(*) || ' results' || chr(10) || chr(10)
           || string_agg(CASE WHEN rank <= 3 THEN part ELSE '' END, '' ORDER BY rank) AS context
         FROM parts GROUP BY query_id, collection, status
         UNION ALL SELECT query_id, 'No relevant information was found in our records.' FROM checked WHERE error IS NOT NULL""",
)
def r7(fx):
    context = replies.knowledge_context(C("metadata"), C("results"))
    return _envelopes(fx, 4).select("query_id", context.alias("context"))


def _prompt_sql(heading: str, material: str, source: str) -> str:
    before, rest = replies.PROMPT.split("{heading}")
    middle, rest = rest.split("{material}")
    after, end = rest.split("{source}")
    return " || ".join([sql_text(before + heading + middle), material, sql_text(after + source + end)])


@query(
    "r8_prompts",
    f"""SELECT page_id, {_prompt_sql('Relevant Information (Template)', 'html', 'template')} AS template_prompt,
            {_prompt_sql('Relevant Information', 'html', 'search results')} AS search_prompt FROM pages""",
)
def r8(fx):
    return fx.table("pages").select(
        "page_id",
        replies.template_prompt(C("html")).alias("template_prompt"),
        replies.search_prompt(C("html")).alias("search_prompt"),
    )


@query(
    "r9_ticket_prompt",
    over("fx_emails")
    + f"""SELECT src_order, {sql_text(replies.TICKET_SYSTEM)} AS system, chr(10) || 'TICKET DETAILS:' || chr(10) || '- Ticket ID: ' || ticket
            || chr(10) || '- Response Type: general' || chr(10) || '- Customer Query: ' || subject || chr(10) || chr(10)
            || 'KNOWLEDGE BASE CONTEXT:' || chr(10) || CASE WHEN trim(email_body) = '' THEN {sql_text(replies.NO_KNOWLEDGE)} ELSE email_body END
            || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10) || {sql_text(replies.TICKET_INSTRUCTIONS)} || chr(10) || chr(10)
            || 'RESPONSE:' || chr(10) AS user FROM fx_emails""",
)
def r9(fx):
    prompt = replies.ticket_prompt(C("ticket"), C("subject"), C("email_body"), F.lit("general"))
    return fx.emails.select("src_order", prompt.alias("p")).select("src_order", "p.system", "p.user")


def open_echo():
    """A generator for checks: answers with the length of the prompt."""
    return lambda prompt: f"Email Body: \n\nlength {len(prompt)}"


@query(
    "r10_generate",
    over("fx_emails")
    + """SELECT src_order, 'Email Body: ' || chr(10) || chr(10) || 'length ' || length(subject) AS generated,
           CAST(NULL AS VARCHAR) AS generation_error FROM fx_emails""",
)
def r10(fx):
    prompts = fx.emails.select("src_order", C("subject").alias("prompt"))
    answered = replies.generate(prompts, open_echo, ["src_order"])
    return answered.select("src_order", "generated", "generation_error")


def open_tagged(tag: str):
    def opened():
        return lambda prompt: f"{tag}: {len(prompt)}"

    return opened


@query(
    "r10_resumed_answers",
    over("fx_emails", "early AS (SELECT DISTINCT subject FROM fx_emails WHERE src_order % 3 = 0)")
    + """SELECT src_order, CASE WHEN subject IN (SELECT subject FROM early) THEN 'first: ' ELSE 'second: ' END || length(subject) AS generated,
           CAST(NULL AS VARCHAR) AS generation_error FROM fx_emails""",
)
def r10_resumed(fx):
    """A run over some of the emails, then one over all: a prompt that has an answer is not asked again."""
    prompts = fx.emails.select("src_order", C("subject").alias("prompt"))
    path = scratch_path(fx.spark, "answers")
    replies.generate(prompts.where("src_order % 3 = 0"), open_tagged("first"), ["src_order"], answers=path)
    answered = replies.generate(prompts, open_tagged("second"), ["src_order"], answers=path, chunk=20_000)
    return answered.select("src_order", "generated", "generation_error")


@query(
    "r11_clean_reply",
    "SELECT doc_id, trim(text, ' ' || chr(10)) AS reply FROM documents",
)
def r11(fx):
    noisy = F.concat(F.lit(" \nEMAIL body: \t\n\n"), tx.strip(C("text")), F.lit("\n \t"))
    return fx.table("documents").select("doc_id", replies.clean_reply(noisy).alias("reply"))


@query(
    "r12_parse_output",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Error: k ' || value WHEN 'click' THEN 'Error: Could not find JSON in output'
         WHEN 'view' THEN 'Error: Could not parse output' ELSE 'value ' || value END AS reply FROM events""",
)
def r12(fx):
    value = C("value").cast("string")
    kind = C("event_type")
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.concat(F.lit("email body: value "), value).alias("email_response")))
    failure = F.to_json(F.struct(F.lit("error").alias("status"), F.concat(F.lit("k "), value).alias("error")))
    output = F.concat(
        F.lit("took 0.1 seconds\n"), F.when(kind == "error", failure).when(kind == "click", "").when(kind == "view", "{broken").otherwise(body)
    )
    return fx.table("events").select("event_id", replies.parse_output(output).alias("reply"))


@query(
    "r14_printed_reply",
    over("fx_emails")
    + f"""SELECT src_order, '=== GENERATED EMAIL ===' || chr(10) || chr(10) || 'Ticket ID: ' || ticket || chr(10) || 'Subject: '
            || CASE WHEN src_order % 2 = 0 THEN {sql_text(replies.DEFAULT_SUBJECT)} ELSE subject END || chr(10) || chr(10) || email_body
            || chr(10) || chr(10) || '=== END OF EMAIL ===' || chr(10) AS reply FROM fx_emails""",
)
def r14(fx):
    subject = F.when(C("src_order") % 2 == 0, "").otherwise(C("subject"))
    return fx.emails.select("src_order", replies.printed_reply(C("ticket"), subject, C("email_body")).alias("reply"))


# --- resume and append ----------------------------------------------------------------


def _earlier(fx):
    """Result rows of an earlier run over the emails whose turn is even; every third of them failed."""
    turn = C("src_order") % 2
    return fx.emails.where(turn == 0).select(
        "ticket", "src_order", "subject", "email_body",
        F.lit("earlier").alias("response_generated"),
        F.when(C("src_order") % 3 == 0, "error").otherwise("search").alias("outcome"),
    )


EARLIER_SQL = """earlier AS (SELECT ticket, src_order, subject, email_body, 'earlier' AS response_generated,
       CASE WHEN src_order % 3 = 0 THEN 'error' ELSE 'search' END AS outcome FROM fx_emails WHERE src_order % 2 = 0)"""


@query(
    "p2_resume",
    over("fx_emails", EARLIER_SQL)
    + """SELECT ticket, src_order, ticket NOT IN (SELECT ticket FROM earlier) AS untouched FROM fx_emails
         WHERE ticket NOT IN (SELECT ticket FROM earlier WHERE outcome <> 'error')""",
)
def p2(fx):
    open_again = batch.not_done(fx.emails.select("ticket", "src_order"), _earlier(fx), retry_errors=True)
    untouched = batch.not_done(open_again, _earlier(fx)).select("src_order", F.lit(True).alias("untouched"))
    joined = open_again.join(untouched, "src_order", "left")
    return joined.select("ticket", "src_order", F.coalesce("untouched", F.lit(False)).alias("untouched"))


@query(
    "p2_bucketed_resume",
    over("fx_emails", EARLIER_SQL)
    + "SELECT ticket, src_order FROM fx_emails WHERE ticket NOT IN (SELECT ticket FROM earlier WHERE outcome <> 'error')",
)
def p2_bucketed(fx):
    """The resume against results dealt out by ticket, which are read where they lie."""
    table = f"results_{uuid.uuid4().hex}"
    rest = [F.lit(None).cast("string").alias(c) for c in ("template_referred", "error")]
    writers.append_bucketed(_earlier(fx).select("*", *rest), table, buckets=16)
    try:
        return materialise(batch.not_done(fx.emails.select("ticket", "src_order"), fx.spark.table(table), retry_errors=True), "open")
    finally:
        fx.spark.sql(f"DROP TABLE {table}")


@query(
    "p3_append",
    over("fx_emails", EARLIER_SQL)
    + """SELECT ticket, src_order, subject, email_body, response_generated, outcome, CAST(NULL AS VARCHAR) AS template_referred FROM earlier
         UNION ALL SELECT ticket, src_order, subject, email_body, 'new', 'search', 'used search' FROM fx_emails
         WHERE ticket NOT IN (SELECT ticket FROM earlier)""",
)
def p3(fx):
    new = batch.not_done(fx.emails, _earlier(fx)).select(
        "*", F.lit("new").alias("response_generated"), F.lit("search").alias("outcome"), F.lit("used search").alias("template_referred")
    )
    return batch.append_results(_earlier(fx), new)


@query(
    "p5_default_label",
    over("fx_emails")
    + """SELECT ticket, CASE WHEN src_order % 3 = 0 THEN 'error' ELSE 'search' END AS outcome,
           CASE WHEN src_order % 3 = 0 THEN 'unknown' ELSE 'used search' END AS template_referred FROM fx_emails""",
)
def p5(fx):
    failed = C("src_order") % 3 == 0
    told = fx.emails.select(
        "ticket", F.when(failed, "error").otherwise("search").alias("outcome"), F.when(~failed, "used search").alias("template_referred")
    )
    return batch.label_missing(told)


# --- files ----------------------------------------------------------------------------


@query(
    "s3_ticket_scan",
    over("fx_tickets")
    + """SELECT ticket, alt_ticket, src_order, data_from, loan_status, repayment_status, lr_status, nullif(category_raw, '') AS category_raw
         FROM fx_tickets""",
)
def s3(fx):
    path = scratch_path(fx.spark, "tickets")
    headers = {name: header for header, name in readers.TICKET_COLUMNS.items()}
    writers.export_csv(fx.tickets.withColumnsRenamed(headers), path)
    return readers.read_tickets(fx.spark, path, order="src_order")


@query(
    "s3_file_order",
    """SELECT CAST(o_custkey AS VARCHAR) AS ticket, arg_min(o_orderpriority, o_orderkey) AS data_from,
         arg_min(o_orderstatus, o_orderkey) AS loan_status FROM orders GROUP BY ALL""",
)
def s3_order(fx):
    """First row per ticket over files of unequal size that have no order column."""
    path = scratch_path(fx.spark, "tickets")
    delivered = fx.table("orders").select(
        C("o_custkey").alias("Ticket ID"), C("o_orderpriority").alias("data_from"), C("o_orderstatus").alias("Loan Status"), "o_orderkey",
        F.lpad(F.floor(F.log2(C("o_orderkey") + 1)).cast("string"), 2, "0").alias("part"),
    )
    delivered.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").csv(path, header=True)
    return tickets.first_per_ticket(readers.read_tickets(fx.spark, path), ["data_from", "loan_status"])


def _in_small_splits(fx, read):
    """``read()`` with splits far below the size of the files; read at once, while the setting holds."""
    sizes = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {key: fx.spark.conf.get(key) for key in sizes}
    for key, value in sizes.items():
        fx.spark.conf.set(key, value)
    try:
        return materialise(read(), "split-read")
    finally:
        for key, value in before.items():
            fx.spark.conf.set(key, value)


@query(
    "s3_split_order",
    """SELECT CAST(o_custkey AS VARCHAR) AS ticket, arg_min(o_orderpriority, o_orderkey) AS data_from,
         arg_min(o_orderstatus, o_orderkey) AS loan_status FROM orders GROUP BY ALL""",
)
def s3_split(fx):
    """First row per ticket (T3) over split files without an order column: their order is file, split and place in it."""
    path = scratch_path(fx.spark, "tickets")
    delivered = fx.table("orders").select(C("o_custkey").alias("Ticket ID"), C("o_orderpriority").alias("data_from"), C("o_orderstatus").alias("Loan Status"), "o_orderkey")
    delivered.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(path, header=True)
    rows = _in_small_splits(fx, lambda: readers.read_tickets(fx.spark, path, multi_line=False))
    return tickets.first_per_ticket(rows, ["data_from", "loan_status"])


@query(
    "s4_split_order",
    over("fx_emails")
    + """SELECT ticket, replace(replace(subject, chr(13), ' '), chr(10), ' ') AS subject,
           replace(replace(email_body, chr(13), ' '), chr(10), ' ') AS email_body,
           row_number() OVER (ORDER BY src_order) AS place FROM fx_emails""",
)
def s4_split(fx):
    """The emails of split files in the order they were delivered (S4), on one line each."""
    path = scratch_path(fx.spark, "emails")
    flat = fx.emails.withColumns({c: F.translate(c, "\r\n", "  ") for c in ("subject", "email_body")})
    flat.withColumnRenamed("ticket", "Ticket ID").repartitionByRange(3, "src_order").sortWithinPartitions("src_order").write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    rows = _in_small_splits(fx, lambda: readers.read_batch(fx.spark, path, multi_line=False))
    return catalog.number_rows(rows, "src_order").select("ticket", "subject", "email_body", C("number").cast("bigint").alias("place"))


@query("s4_batch_scan", over("fx_emails") + "SELECT ticket, src_order, subject, email_body FROM fx_emails")
def s4(fx):
    path = scratch_path(fx.spark, "emails")
    writers.export_csv(fx.emails.withColumnRenamed("ticket", "Ticket ID"), path)
    return readers.read_batch(fx.spark, path, order="src_order")


@query(
    "s6_template_scan",
    over("fx_templates") + "SELECT 'page_' || collection AS collection, html || chr(10) AS html FROM fx_templates",
)
def s6(fx):
    """Templates written as one file per name and read back as whole files."""
    path = scratch_path(fx.spark, "templates")
    named = fx.templates.select("html", F.concat(F.lit("Page "), C("collection")).alias("name"))
    named.write.partitionBy("name").text(path)
    return readers.read_templates(fx.spark, path, name_pattern="name=([^/]+)/").select("collection", "html")


@query(
    "s7_replace_collection",
    over("fx_kb")
    + "SELECT collection, kb_id, CASE WHEN collection = 'src3' THEN 'replaced' ELSE subject END AS subject FROM fx_kb",
)
def s7(fx):
    path = scratch_path(fx.spark, "kb")
    stored = fx.kb.select("kb_id", "subject", "collection")
    writers.write_collections(stored, path)
    again = stored.where(C("collection") == "src3").withColumn("subject", F.lit("replaced"))
    writers.write_collections(again, path)
    return fx.spark.read.schema("kb_id bigint, subject string, collection string").parquet(path)


@query(
    "s10_result_table",
    over("fx_emails", "told AS (SELECT ticket, src_order, CASE WHEN src_order % 3 = 0 THEN 'error' ELSE 'search' END AS outcome FROM fx_emails)")
    + "SELECT * FROM told UNION ALL SELECT * FROM told WHERE outcome = 'error'",
)
def s10(fx):
    path = scratch_path(fx.spark, "results")
    outcome = F.when(C("src_order") % 3 == 0, "error").otherwise("search").alias("outcome")
    rest = [F.lit(None).cast("string").alias(c) for c in ("response_generated", "template_referred", "error")]
    full = fx.emails.select("ticket", "src_order", "subject", "email_body", outcome, *rest)
    writers.append_results(full, path)
    writers.append_results(full.where(C("outcome") == "error"), path)
    return readers.read_results(fx.spark, path).select("ticket", "src_order", "outcome")


@query(
    "s11_envelope_files",
    _text_hits_sql(BOTH_TEXTS, 2)
    + f""", {CHECKED_SQL} SELECT collection, query_subject, query_body, error, CAST(rank AS INT) AS rank, CAST(kb_id AS VARCHAR) AS id,
           score AS distance, response AS status FROM checked""",
)
def s11(fx):
    """Envelopes written as JSON and read back by the envelope reader (S5)."""
    path = scratch_path(fx.spark, "envelopes")
    writers.write_envelopes(_envelopes(fx, 2).drop("query_id"), path)
    read = readers.read_envelopes(fx.spark, path, multi_line=False)
    told = read.select("metadata.collection", "metadata.query_subject", "metadata.query_body", "error", F.explode_outer("results").alias("r"))
    return told.select(
        "collection", "query_subject", "query_body", "error", "r.rank", "r.id", "r.distance", "r.status"
    )


@query(
    "s5_envelope_scan",
    FAILED + "SELECT error, coalesce(error, status) AS said, count(*) AS envelopes FROM failed GROUP BY ALL",
)
def s5(fx):
    """Error envelopes beside envelopes with results, of which the schema fits both."""
    path = scratch_path(fx.spark, "envelopes")
    result = F.struct(F.lit(1).alias("rank"), C("src_order").cast("string").alias("id"), C("status"))
    results = F.when(C("error").isNull(), F.array(result))
    writers.write_envelopes(_failed(fx).select("error", results.alias("results")), path)
    read = readers.read_envelopes(fx.spark, path, multi_line=False)
    said = F.coalesce("error", F.get("results", F.lit(0))["status"])
    return read.groupBy("error", said.alias("said")).agg(F.count(F.lit(1)).alias("envelopes"))


@query(
    "s12_prior_results",
    over("fx_emails", EARLIER_SQL)
    + """SELECT ticket, src_order, 'none' AS earlier FROM fx_emails
         UNION ALL SELECT ticket, src_order, 'some' FROM fx_emails WHERE ticket NOT IN (SELECT ticket FROM earlier)""",
)
def s12(fx):
    """Open emails without a result table, and with the results of an earlier run."""
    path = scratch_path(fx.spark, "results")
    emails = fx.emails.select("ticket", "src_order")
    first = batch.not_done(emails, readers.read_results(fx.spark, path)).withColumn("earlier", F.lit("none"))
    writers.append_results(_earlier(fx).withColumns({c: F.lit(None).cast("string") for c in ("template_referred", "error")}), path)
    later = batch.not_done(emails, readers.read_results(fx.spark, path)).withColumn("earlier", F.lit("some"))
    return first.unionByName(later)


@query(
    "s13_reply_texts",
    over("fx_emails")
    + """SELECT '=== GENERATED EMAIL ===' || chr(10) || chr(10) || 'Ticket ID: ' || ticket || chr(10) || 'Subject: ' || subject || chr(10)
           || chr(10) || email_body || chr(10) || chr(10) AS reply FROM fx_emails""",
)
def s13(fx):
    """Printed replies written one after the other and read back, cut at their last line."""
    path = scratch_path(fx.spark, "replies")
    printed = replies.printed_reply(C("ticket"), C("subject"), C("email_body"))
    writers.write_reply_texts(fx.emails.select(printed.alias("reply")), path)
    read = fx.spark.read.text(path, lineSep="=== END OF EMAIL ===\n")
    # The writer ends each text with a line break of its own.
    return read.select(F.regexp_replace("value", "^\n", "").alias("reply")).where("reply <> ''")


JSON_OUTCOMES = "['search', 'template_fallback', 'generic_fallback', 'error']"


@query(
    "s13_reply_json",
    over("fx_emails")
    + f""", told AS (SELECT *, list_extract({JSON_OUTCOMES}, CAST(src_order % 4 AS INT) + 1) AS outcome FROM fx_emails)
       SELECT src_order, CASE WHEN outcome = 'error' THEN 'error' ELSE 'success' END AS status, email_body AS email_response,
         CASE WHEN outcome = 'search' THEN 'm' END AS model, outcome LIKE '%fallback' AS fallback_template_used,
         CASE outcome WHEN 'template_fallback' THEN 'FALL BACK TEMPLATE USED (LLM)' WHEN 'generic_fallback' THEN 'GENERIC FALLBACK USED' END AS flag
       FROM told""",
)
def s13_json(fx):
    """Replies written as JSON texts and read back."""
    path = scratch_path(fx.spark, "replies")
    outcome = F.get(F.array(*map(F.lit, ["search", "template_fallback", "generic_fallback", "error"])), C("src_order") % 4)
    told = fx.emails.withColumn("outcome", outcome)
    model = F.when(C("outcome") == "search", "m")
    text = replies.reply_json(C("outcome"), C("email_body"), model, F.lit(None).cast("string"))
    told.select("src_order", text.alias("reply")).write.json(path)
    shape = "status string, email_response string, metadata struct<model string, fallback_template_used boolean, fallback_template_flag string>"
    read = fx.spark.read.schema("src_order bigint, reply string").json(path).withColumn("reply", F.from_json("reply", shape))
    return read.select(
        "src_order", "reply.status", "reply.email_response", "reply.metadata.model",
        "reply.metadata.fallback_template_used", C("reply.metadata.fallback_template_flag").alias("flag"),
    )
