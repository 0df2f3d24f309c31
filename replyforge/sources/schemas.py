"""Schemas of the delivered files and of the stored tables."""

from __future__ import annotations

# Delivered ticket header -> column name.
TICKET_COLUMNS = {
    "Ticket ID": "ticket",
    "ticket_id": "alt_ticket",
    "data_from": "data_from",
    "Loan Status": "loan_status",
    "repayment_status": "repayment_status",
    "lr_status": "lr_status",
    "new": "category_raw",
}

# Columns a batch and a sheet must have, and the words pandas' CSV reader takes for missing.
BATCH_COLUMNS = ["ticket", "subject", "email_body"]
SHEET_COLUMNS = ["subject", "email_body"]
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ENVELOPE = """
    error string,
    metadata struct<collection string, query_subject string, query_body string, status_field string,
                    top_k int, timestamp string, results_count int>,
    results array<struct<rank int, id string, distance double, status string, fields map<string, string>>>
"""

RESULTS = """
    ticket string, src_order bigint, subject string, email_body string, response_generated string,
    template_referred string, outcome string, error string
"""

KB = "collection string, kb_id bigint, subject string, email_body string, fields map<string, string>, vector array<float>"
