"""Registered queries: cleaning, ticket status, texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyforge.functions import status as st
from replyforge.functions import text as tx
from replyforge.functions import vectors as vec
from replyforge.operators import catalog, joins, search, tickets
from replyforge.plans.fixtures import ALL_STATUS_FIELDS
from replyforge.plans.registry import (
    CLASSIFIED,
    KB_EMBEDDED,
    KB_TEXT,
    RESOLVED,
    over,
    query,
    sql_nullish,
    sql_query_text,
    sql_strip,
    sql_words,
)
from replyforge.sources.readers import all_text, rename_columns

C = F.col

# --- cleaning -------------------------------------------------------------------------


@query(
    "q1_sanitize_name",
    f"""SELECT page_id, trim(regexp_replace(regexp_replace(lower({sql_strip('url')}), '[^a-z0-9_]+', '_', 'g'),
          '_+', '_', 'g'), '_') AS name FROM pages""",
)
def q1(fx):
    return fx.table("pages").select("page_id", tx.sanitize_name(C("url")).alias("name"))


@query(
    "q2_sanitize_field",
    """SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS name
       FROM pages""",
)
def q2(fx):
    return fx.table("pages").select("page_id", tx.sanitize_field(C("url")).alias("name"))


@query("q3_sanitize_collection", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM pages")
def q3(fx):
    return fx.table("pages").select("page_id", tx.sanitize_collection(C("url")).alias("name"))


@query(
    "q4_escape_text",
    r"""SELECT page_id, replace(replace(replace(html, '"', '\"'), '`', '\`'), '$', '\$') AS html FROM pages""",
)
def q4(fx):
    return fx.table("pages").select("page_id", tx.escape_text(C("html")).alias("html"))


@query(
    "q6_similar_columns",
    over("fx_fields")
    + """, wanted AS (SELECT unnest(['IMClosed', 'email', 'the_subject_line']) AS required)
       SELECT collection, required, coalesce(string_agg(field, ', ' ORDER BY ordinal) FILTER (
            WHERE contains(lower(field), lower(required)) OR contains(lower(required), lower(field))), '') AS similar
       FROM fx_fields, wanted GROUP BY ALL""",
)
def q6(fx):
    required = F.explode(tx.names_of(["IMClosed", "email", "the_subject_line"]))
    schemas = search.collection_schemas(fx.fields).withColumn("required", required)
    return schemas.select(
        "collection", "required", F.array_join(tx.similar_names(C("required"), C("fields")), ", ").alias("similar")
    )


@query("q7_rename", over("fx_tickets") + "SELECT ticket, src_order FROM fx_tickets")
def q7(fx):
    delivered = fx.tickets.withColumnRenamed("ticket", "Ticket ID")
    return rename_columns(delivered).select("ticket", "src_order")


@query(
    "q8_all_text",
    over("fx_kb")
    + """SELECT collection, CAST(kb_id AS VARCHAR) AS kb_id, subject, coalesce(email_body, '') AS email_body FROM fx_kb""",
)
def q8(fx):
    return all_text(fx.kb.select("collection", "kb_id", "subject", "email_body"))


Q9_SQL = " UNION ALL ".join(
    f"SELECT collection, kb_id, '{f}' AS field, {f} AS response FROM fx_kb" for f in ALL_STATUS_FIELDS
)


@query(
    "q9_unpivot_responses",
    over("fx_kb fx_fields", f"responses AS ({Q9_SQL})")
    + "SELECT r.* FROM responses r JOIN fx_fields f ON f.collection = r.collection AND f.field = r.field",
)
def q9(fx):
    responses = fx.kb.unpivot(["collection", "kb_id"], ALL_STATUS_FIELDS, "field", "response")
    known = fx.fields.select("collection", "field", F.lit(True).alias("known"))
    return joins.lookup_join(responses, known, ["collection", "field"], ["kb_id"]).where("known").drop("known")


@query(
    "q10_cut_text",
    "SELECT doc_id, substring(text, 1, 65535) AS text, length(text) > 65535 AS was_cut FROM documents",
)
def q10(fx):
    text = C("text")
    return fx.table("documents").select(
        "doc_id", tx.cut_text(text).alias("text"), (F.length(text) > tx.MAX_TEXT).alias("was_cut")
    )


@query(
    "q11_empty_sheets",
    over("fx_kb fx_category_map")
    + """SELECT collection, FALSE AS is_placeholder, count(*) AS "rows" FROM fx_kb GROUP BY ALL
         UNION ALL SELECT collection, TRUE, 1 FROM fx_category_map m
         WHERE NOT EXISTS (SELECT 1 FROM fx_kb k WHERE k.collection = m.collection)""",
)
def q11(fx):
    kb = fx.kb.select("collection", "kb_id", "subject", "email_body")
    sheets = fx.category_map.select("collection")
    return catalog.collection_counts(catalog.with_placeholders(kb, sheets), ["collection", "is_placeholder"])


@query("q13_nullish", over("fx_tickets") + f"SELECT src_order, {sql_nullish('data_from')} AS im FROM fx_tickets")
def q13(fx):
    return fx.tickets.select("src_order", tx.nullish(C("data_from")).alias("im"))


# --- ticket status and category -------------------------------------------------------


@query(
    "t1_ticket_lookup",
    over("fx_tickets fx_emails")
    + """SELECT e.ticket, e.src_order, t.data_from, t.loan_status, t.repayment_status, t.lr_status, t.category_raw
         FROM fx_emails e LEFT JOIN fx_tickets t ON t.ticket = e.ticket""",
)
def t1(fx):
    emails = fx.emails.select("ticket", "src_order")
    return joins.salted_left_join(emails, tickets.first_per_ticket(fx.tickets), ["ticket"], ["src_order"])


@query(
    "t2_alternative_id",
    over("fx_tickets fx_emails")
    + """SELECT e.ticket, e.src_order, CASE WHEN t.ticket IS NOT NULL THEN 'direct'
                WHEN a.ticket IS NOT NULL THEN 'alternative' ELSE 'none' END AS matched_by,
           CASE WHEN t.ticket IS NOT NULL THEN t.loan_status ELSE a.loan_status END AS loan_status
         FROM fx_emails e LEFT JOIN fx_tickets t ON t.ticket = e.ticket
         LEFT JOIN fx_tickets a ON a.alt_ticket = e.ticket""",
)
def t2(fx):
    found = tickets.look_up(fx.emails.select("ticket", "src_order"), fx.tickets, ["loan_status"])
    return found.select("ticket", "src_order", "matched_by", "loan_status")


@query(
    "t3_first_match",
    """SELECT CAST(o_custkey AS VARCHAR) AS ticket, arg_min(o_orderpriority, o_orderkey) AS data_from,
         arg_min(o_orderstatus, o_orderkey) AS loan_status FROM orders GROUP BY ALL""",
)
def t3(fx):
    repeated = fx.table("orders").select(
        C("o_custkey").cast("string").alias("ticket"), C("o_orderkey").alias("src_order"),
        C("o_orderpriority").alias("data_from"), C("o_orderstatus").alias("loan_status"),
    )
    return tickets.first_per_ticket(repeated, ["data_from", "loan_status"])


@query(
    "t4_status_list",
    over("fx_tickets", CLASSIFIED[0])
    + """SELECT src_order, CASE WHEN coalesce(ls, rs) IS NOT NULL THEN concat_ws('|', ls, rs)
                ELSE coalesce(lr, '') END AS statuses FROM cleaned""",
)
def t4(fx):
    statuses = st.status_list(C("loan_status"), C("repayment_status"), C("lr_status"))
    return fx.tickets.select("src_order", F.array_join(statuses, "|").alias("statuses"))


@query(
    "t5_status_words",
    over("fx_tickets", CLASSIFIED[0])
    + f"SELECT src_order, {sql_words('loan')} AS loan, {sql_words('repay')} AS repayment FROM cleaned",
)
def t5(fx):
    return st.with_status_words(fx.tickets).select("src_order", "loan", "repayment")


@query("t6_status_key", over("fx_tickets", *CLASSIFIED[:3]) + "SELECT src_order, status_key FROM keyed")
def t6(fx):
    key = st.status_key(C("im"), C("loan"), C("repayment"), C("no_status"))
    return st.with_status_words(fx.tickets).select("src_order", key.alias("status_key"))


@query(
    "t7_direct_status",
    over("fx_tickets") + f"SELECT src_order, coalesce({sql_strip('lr_status')}, 'nan') AS status FROM fx_tickets",
)
def t7(fx):
    return fx.tickets.select("src_order", st.direct_status(C("lr_status")).alias("status"))


@query("t8_strip_number", over("fx_tickets fx_category_map", *CLASSIFIED) + "SELECT src_order, status FROM classified")
def t8(fx):
    return st.with_status(fx.tickets).select("src_order", "status")


@query("t9_map_category", over("fx_tickets fx_category_map", *CLASSIFIED) + "SELECT src_order, category FROM classified")
def t9(fx):
    return tickets.classify(fx.tickets, fx.category_map).select("src_order", "category")


# Fixed values, written out again to check the ones in use.
CATEGORIES = [
    ("predisbursal_loan_query_loan_cancellation_request", "predisbursal_loan_query_loan_ca"),
    ("collection_query", "collection_query"),
    ("data_erasure_request__", "data_erasure_request"),
    ("predisbursal_loan_query_credit_team_action_pending", "predisbursal_loan_query_credit"),
    ("predisbursal_loan_query_loan_approved_disbursed", "predisbursal_loan_query_loan_ap"),
    ("predisbursal_loan_query_other_bs_isssues", "predisbursal_loan_query_other_b"),
    ("predisbursal_loan_query_bs_issue_maximum_attempt_reach", "predisbursal_loan_query_bs_issu"),
    ("predisbursal_loan_query_im+_instances_loc-live-withdrawal_request_placed", "predisbursal_loan_query_im_inst"),
    ("post_loan_closure_queries_surrender_of_im+limit", "post_loan_closure_queries_surre"),
    ("post_loan_disbursal_query_basic_emi_-ecs_details_emi_amount", "post_loan_disbursal_query_basic"),
    ("post_loan_closure_queries", "post_loan_closure_queries"),
    ("post_loan_disbursal_query_basic_emi_-ecs_details_ecs_approved,_but_not_triggered", "post_loan_disbursal_query_bas_1"),
    ("post_loan_disbursal_query_payment_ecs_payment", "post_loan_disbursal_query_payme"),
    ("post_loan_disbursal_query", "post_loan_disbursal_query"),
    ("post_loan_disbursal_query_basic_emi_-ecs_details_ecs_status", "post_loan_disbursal_query_bas_2"),
    ("canceled_loan_checking_for_reason_", "canceled_loan_checking_for_reas"),
    ("post_loan_disbursal_query_basic_emi_-ecs_details_emi_date_change_request", "post_loan_disbursal_query_bas_3"),
    ("update_-_edit_details_bank_account_details_", "update_edit_details_bank_accou"),
    ("update_-_edit_details_mobile_number", "update_edit_details_mobile_num"),
    ("update_-_edit_details_email_id", "update_edit_details_email_id"),
    ("post_loan_disbursal_query_basic_emi_-ecs_details_loan_closure_amount", "post_loan_disbursal_query_bas_4"),
    ("post_loan_disbursal_query_payment_dual_payment_not_updated", "post_loan_disbursal_query_pay_1"),
    ("post_loan_disbursal_query_payment_refund_request", "post_loan_disbursal_query_pay_2"),
    ("predisbursal_loan_query_general_info", "predisbursal_loan_query_general"),
    ("predisbursal_loan_query_im+_instances", "predisbursal_loan_query_im_in_1"),
    ("predisbursal_loan_query_incomplete_profile", "predisbursal_loan_query_incompl"),
    ("predisbursal_loan_query_loan_approved_disbursal_in_progress", "predisbursal_loan_approved_disb"),
    ("stop_marketing_sms-emails_details_added_in_the_sheet_", "stop_marketing_sms_emails_detai"),
    ("unregistered-no_content_registered_credentials_needed", "unregistered_no_content_registe"),
    ("collection_queries_settlement_query", "collection_queries_settlement_q"),
    ("post_loan_closure_queries_credit_report_issues", "post_loan_closure_queries_credi"),
    ("post_loan_closure_queries_loan_related_documents_required_", "post_loan_closure_queries_loan"),
    ("predisbursal_loan_query_kyc_issue_pan-aadhar_exists", "predisbursal_loan_query_kyc_iss"),
    ("predisbursal_loan_query_nach_issue_general_information", "predisbursal_loan_query_nach_is"),
    ("predisbursal_loan_query_nach_issue_unable_to_proceed_enach", "predisbursal_loan_query_nach_1"),
    ("predisbursal_loan_query_rf-vf_query_general_information", "predisbursal_loan_query_rf_vf_q"),
    ("predisbursal_loan_query_rf-vf_query_rf-vf_paid_not_updated", "predisbursal_loan_query_rf_vf_p"),
    ("rejected_loan_cancel_enach_", "rejected_loan_cancel_enach"),
    ("rejected_loan_checking_for_reason", "rejected_loan_checking_for_reas"),
    ("rejected_loan_requesting_for_refund_", "rejected_loan_requesting_for_re"),
    ("rejected_loan_wants_to_re-apply-re-consider", "rejected_loan_wants_to_re_apply"),
    ("update_-_edit_details_address", "update_edit_details_address"),
    ("update_-_edit_details_name", "update_edit_details_name"),
]
CATEGORY_ROWS = ", ".join(f"({i}, '{raw}', '{name}')" for i, (raw, name) in enumerate(CATEGORIES))


@query(
    "t9_fixed_map",
    over("fx_tickets")
    + f"""SELECT src_order, coalesce(m.name, CASE WHEN src_order % 45 = {len(CATEGORIES)} THEN 'no_such_category' ELSE 'nan' END) AS category
          FROM fx_tickets LEFT JOIN (VALUES {CATEGORY_ROWS}) AS m(i, raw, name) ON m.i = src_order % 45""",
)
def t9_fixed(fx):
    """Every pair of the fixed map in mixed letter case, an unknown category and a missing one."""
    raw = F.get(F.array(*[F.lit(raw) for raw, _ in CATEGORIES], F.lit("no_such_category")), C("src_order") % 45)
    delivered = fx.tickets.withColumn("category_raw", F.when(C("src_order") % 2 == 0, F.upper(raw)).otherwise(raw))
    return tickets.classify(delivered).select("src_order", "category")


@query(
    "t10_collection_name",
    over("fx_tickets fx_category_map", *CLASSIFIED)
    + """SELECT src_order, coalesce(b.collection, regexp_replace(category, '[^a-zA-Z0-9_]', '_', 'g')) AS batch,
           coalesce(m.collection, category) AS manual
         FROM classified c LEFT JOIN fx_category_map b ON b.raw = regexp_replace(category, '[^a-zA-Z0-9_]', '_', 'g')
         LEFT JOIN fx_category_map m ON m.raw = lower(category)""",
)
def t10(fx):
    known = tickets.classify(fx.tickets, fx.category_map).select("src_order", "status", "category")
    batch = tickets.name_collection(known, fx.category_map).withColumnRenamed("collection", "batch")
    both = tickets.name_collection(batch, fx.category_map, manual=True)
    return both.select("src_order", "batch", C("collection").alias("manual"))


@query(
    "t11_remaps",
    over("fx_tickets fx_category_map", *CLASSIFIED)
    + """SELECT src_order, CASE WHEN status = 'im_closed' THEN 'imclosed' ELSE status END AS status,
           coalesce(category_raw, '') AS category FROM classified""",
)
def t11(fx):
    return st.with_status(fx.tickets).select(
        "src_order",
        st.remap_status(C("status")).alias("status"),
        st.remap_category(F.coalesce("category_raw", F.lit(""))).alias("category"),
    )


@query(
    "t12_not_found",
    over("fx_tickets fx_category_map fx_emails", *RESOLVED)
    + "SELECT src_order, ticket, status, category, matched_by FROM resolved",
)
def t12(fx):
    resolved = tickets.resolve_tickets(fx.emails.select("ticket", "src_order"), fx.tickets, fx.category_map)
    return resolved.select("src_order", "ticket", "status", "category", "matched_by")


# --- texts and vectors ----------------------------------------------------------------


@query("v1_kb_text", over("fx_kb") + f"SELECT kb_id, {KB_TEXT} AS text FROM fx_kb")
def v1(fx):
    return fx.kb.select("kb_id", tx.kb_text(C("subject"), C("email_body")).alias("text"))


@query(
    "v2_query_text",
    over("fx_emails") + f"SELECT src_order, {sql_query_text('subject', 'email_body')} AS text FROM fx_emails",
)
def v2(fx):
    return fx.emails.select("src_order", tx.query_text(C("subject"), C("email_body")).alias("text"))


V3_BODY = f"CASE WHEN {sql_strip('email_body')} = '' THEN subject ELSE email_body END"


@query("v3_body_or_subject", over("fx_emails") + f"SELECT src_order, {sql_query_text('subject', V3_BODY)} AS text FROM fx_emails")
def v3(fx):
    body = tx.body_or_subject(C("subject"), C("email_body"))
    return fx.emails.select("src_order", tx.query_text(C("subject"), body).alias("text"))


@query(
    "v4_embed_hashed",
    over("fx_kb", *KB_EMBEDDED) + "SELECT kb_id, CAST(bucket AS INT) AS bucket, round(w, 6) AS weight FROM kb_vec",
)
def v4(fx):
    texts = fx.kb_spread.select("kb_id", tx.kb_text(C("subject"), C("email_body")).alias("text"))
    # Outer, since for a plain explode Spark adds a size filter that computes every vector twice.
    entries = vec.embed_hashed(texts, "text", "vector").select("kb_id", F.posexplode_outer("vector").alias("bucket", "w"))
    return entries.where(C("w") != 0).select("kb_id", "bucket", F.round(C("w").cast("double"), 6).alias("weight"))


SCALED_SQL = "scaled AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) * (vec_id % 7) AS x FROM embeddings, range(1, 65) t(i))"


@query(
    "v5_l2_normalise",
    over("", SCALED_SQL)
    + """SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 0), 0), 6) AS x
         FROM scaled""",
)
def v5(fx):
    # A seventh of the vectors becomes all zeros.
    factor = C("vec_id") % 7
    scaled = F.transform("embedding", lambda x: x.cast("double") * factor)
    entries = fx.table("embeddings").select("vec_id", F.posexplode_outer(vec.l2_normalise(scaled)).alias("pos", "x"))
    return entries.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query(
    "v6_fit_dim",
    """SELECT vec_id, 384 AS padded, 32 AS cut, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS padded_sum,
         round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) AS cut_sum, 0.0::DOUBLE AS last
       FROM embeddings""",
)
def v6(fx):
    padded, cut = vec.fit_dim(C("embedding"), 384), vec.fit_dim(C("embedding"), 32)

    def total(v):
        return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)

    return fx.table("embeddings").select(
        "vec_id", F.size(padded).alias("padded"), F.size(cut).alias("cut"),
        total(padded).alias("padded_sum"), total(cut).alias("cut_sum"), F.get(padded, F.lit(383)).alias("last"),
    )


def _neighbours(fx):
    """Each vector beside the vector with the next id."""
    a = fx.table("embeddings").select("vec_id", C("embedding").alias("a"))
    b = fx.table("embeddings").select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("b"))
    return a.join(b, "vec_id")


NEIGHBOURS_SQL = (
    "pairs AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
)


@query("v7_cosine", over("", NEIGHBOURS_SQL) + "SELECT vec_id, round(s, 6) AS similarity FROM pairs")
def v7(fx):
    return _neighbours(fx).select("vec_id", F.round(vec.cosine(C("a"), C("b")), 6).alias("similarity"))


@query("v8_match_percent", over("", NEIGHBOURS_SQL) + "SELECT vec_id, round(s * 100, 2) AS percent FROM pairs")
def v8(fx):
    return _neighbours(fx).select("vec_id", vec.match_percent(vec.cosine(C("a"), C("b"))).alias("percent"))
