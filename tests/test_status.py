import pytest
from pyspark.sql import functions as F

from replyforge.functions import status as st
from replyforge.operators import tickets

SCHEMA = "ticket string, alt_ticket string, src_order long, data_from string, loan_status string, repayment_status string, lr_status string, category_raw string"


def ticket(number, im=None, loan=None, repayment=None, lr=None, category="x", alt=None, order=None):
    return (str(number), alt, number if order is None else order, im, loan, repayment, lr, category)


CASES = [
    # product, loan, repayment, lr, status
    ("IM", None, None, None, "imnostatus"),
    ("IM+", None, None, None, "im_nostatus"),
    ("IM++", None, None, None, "im__nostatus"),
    ("IM", "REJECTED", "REGULAR", None, "imrejected"),
    ("IM", "EXPIRED", None, None, "imexpired"),
    ("IM", "CLOSED", "REGULAR", None, "imclosed"),
    ("IM", "UNDER_REVIEW", None, None, "imunderreview"),
    ("IM+", "UNDER_REVIEW", None, None, "im_underreview"),
    ("IM", "DISBURSED", None, None, "imdisbursed"),
    ("IM", "DISBURSED", "REGULAR", None, "imdisbursedregular"),
    ("IM", "DISBURSED", "DELAYED_1", None, "imdisburseddelayed"),
    ("IM+", "DISBURSED", "DELAYED_3", None, "im_disburseddelayed"),
    ("IM+", "DISBURSED", "WRITTEN_OFF", None, "im_disbursedwritten_off"),
    ("IM+", "CLOSED", None, None, "im_closed"),
    ("IM+", "REJECTED", None, None, "im_rejected"),
    ("IM+", "EXPIRED", None, None, "im_expired"),
    ("IM", "OTHER", None, None, "imnostatus"),
    ("IM+", None, "REGULAR", None, "im_nostatus"),
    ("IM++", "UNDER_REVIEW", "REGULAR", None, "im__under_reviewregular"),
    ("IM++", "CLOSED", None, None, "im__closed"),
    ("IM++", "OTHER", None, None, "im___nostatus"),
    ("IM-", "CLOSED", "DELAYED_1", None, "im-closeddelayed"),
    ("im", "UNDER_REVIEW", None, None, "imunder_review"),
    # by value and not by column; the lr value only without both
    ("IM", "REGULAR", "DISBURSED", None, "imdisbursedregular"),
    ("IM", "DISBURSED", "CLOSED", None, "imclosed"),
    ("IM", " NaN ", "", "CLOSED", "imclosed"),
    ("IM", "OTHER", None, "CLOSED", "imnostatus"),
    ("IM", "closed", None, None, "imnostatus"),
    (" IM ", " CLOSED ", None, None, "imclosed"),
    # no product value: the lr value as it is
    (None, "CLOSED", None, " Processing_12 ", "Processing"),
    ("nan", "CLOSED", None, None, "nan"),
    ("", None, None, "", ""),
]


def test_status_of_every_rule(spark):
    rows = [ticket(i, *case[:4]) for i, case in enumerate(CASES)]
    found = st.with_status(spark.createDataFrame(rows, SCHEMA)).orderBy("src_order").select("status").collect()
    assert [r.status for r in found] == [case[4] for case in CASES]


def test_missing_status_without_compat(spark):
    df = spark.createDataFrame([ticket(1, category=None)], SCHEMA)
    row = tickets.classify(df, compat=False).first()
    assert (row.status, row.category) == ("not_found", "not_found")
    row = tickets.classify(df).first()
    assert (row.status, row.category) == ("nan", "nan")


def test_status_list(spark):
    df = spark.createDataFrame([ticket(1, "IM", " A ", "nan", "L"), ticket(2, "IM", "", None, "L"), ticket(3)], SCHEMA)
    lists = df.select("src_order", st.status_list(F.col("loan_status"), F.col("repayment_status"), F.col("lr_status")).alias("s"))
    assert [r.s for r in lists.orderBy("src_order").collect()] == [["A"], ["L"], []]


def test_category_map(spark):
    assert len(st.CATEGORY_MAP) == 43
    assert all(len(v) <= 31 for v in st.CATEGORY_MAP.values())
    # Mapping twice changes nothing.
    assert all(st.CATEGORY_MAP.get(v, v) == v for v in st.CATEGORY_MAP.values())
    df = spark.createDataFrame([("collection_query",), ("data_erasure_request__",), ("unknown",)], "c string")
    assert [r[0] for r in df.select(st.map_category(F.col("c"))).collect()] == ["collection_query", "data_erasure_request", "unknown"]


@pytest.mark.parametrize("manual", [False, True])
def test_collection_names(spark, manual):
    names = [
        "other_kyc_issues", "predisbursal_loan_query_rf/vf_query_general_information", "", "a+b",
        "predisbursal_loan_query_im+_instances", "update_-_edit_details_bank_account_details_", "data_erasure_request ",
    ]
    df = spark.createDataFrame([(i, "im_closed", c) for i, c in enumerate(names)], "src_order long, status string, category string")
    rows = tickets.name_collection(df, manual=manual).orderBy("src_order").collect()
    assert {r.status for r in rows} == {"imclosed"}
    assert [r.skipped for r in rows] == [True, True, False, False, False, False, False]
    got = [r.collection for r in rows]
    if manual:
        assert got[2:6] == ["", "a+b", "predisbursal_loan_query_im_in_1", "update_edit_details_bank_accou"]
    else:
        # A mapped category arrives mapped; a raw one is made a name first.
        assert got[2:5] == ["", "a_b", "predisbursal_loan_query_im__instances"]


def test_first_match_and_fallback_id(spark):
    rows = [
        ticket(1, "IM", "CLOSED", order=5), ticket(1, "IM", "REJECTED", order=2), ticket(1, "IM", "EXPIRED", order=9),
        ticket(2, "IM", "CLOSED", alt="7", order=1), ticket(7, "IM", "EXPIRED", alt="8", order=20), ticket(3, "IM", "REJECTED", alt="8", order=3),
    ]
    emails = spark.createDataFrame([(t, i, "", "") for i, t in enumerate(["1", "7", "8", "9", None])], "ticket string, src_order long, subject string, email_body string")
    found = tickets.resolve_tickets(emails, spark.createDataFrame(rows, SCHEMA)).orderBy("src_order").collect()
    assert [(r.status, r.matched_by) for r in found] == [
        ("imrejected", "direct"), ("imexpired", "direct"), ("imrejected", "alternative"), ("not_found", "none"), ("not_found", "none"),
    ]
