"""Ticket status and category as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.functions.text import nullish, strip

# Status words by kind, and what a missing ticket is called.
LOAN_STATUSES = ["DISBURSED", "CLOSED", "UNDER_REVIEW", "REJECTED", "EXPIRED"]
REPAYMENT_STATUSES = ["REGULAR", "DELAYED_1", "DELAYED_3", "WRITTEN_OFF"]
NOT_FOUND = "not_found"

# Raw category -> collection name.
CATEGORY_MAP = {
    "predisbursal_loan_query_loan_cancellation_request": "predisbursal_loan_query_loan_ca",
    "collection_query": "collection_query",
    "data_erasure_request__": "data_erasure_request",
    "predisbursal_loan_query_credit_team_action_pending": "predisbursal_loan_query_credit",
    "predisbursal_loan_query_loan_approved_disbursed": "predisbursal_loan_query_loan_ap",
    "predisbursal_loan_query_other_bs_isssues": "predisbursal_loan_query_other_b",
    "predisbursal_loan_query_bs_issue_maximum_attempt_reach": "predisbursal_loan_query_bs_issu",
    "predisbursal_loan_query_im+_instances_loc-live-withdrawal_request_placed": "predisbursal_loan_query_im_inst",
    "post_loan_closure_queries_surrender_of_im+limit": "post_loan_closure_queries_surre",
    "post_loan_disbursal_query_basic_emi_-ecs_details_emi_amount": "post_loan_disbursal_query_basic",
    "post_loan_closure_queries": "post_loan_closure_queries",
    "post_loan_disbursal_query_basic_emi_-ecs_details_ecs_approved,_but_not_triggered": "post_loan_disbursal_query_bas_1",
    "post_loan_disbursal_query_payment_ecs_payment": "post_loan_disbursal_query_payme",
    "post_loan_disbursal_query": "post_loan_disbursal_query",
    "post_loan_disbursal_query_basic_emi_-ecs_details_ecs_status": "post_loan_disbursal_query_bas_2",
    "canceled_loan_checking_for_reason_": "canceled_loan_checking_for_reas",
    "post_loan_disbursal_query_basic_emi_-ecs_details_emi_date_change_request": "post_loan_disbursal_query_bas_3",
    "update_-_edit_details_bank_account_details_": "update_edit_details_bank_accou",
    "update_-_edit_details_mobile_number": "update_edit_details_mobile_num",
    "update_-_edit_details_email_id": "update_edit_details_email_id",
    "post_loan_disbursal_query_basic_emi_-ecs_details_loan_closure_amount": "post_loan_disbursal_query_bas_4",
    "post_loan_disbursal_query_payment_dual_payment_not_updated": "post_loan_disbursal_query_pay_1",
    "post_loan_disbursal_query_payment_refund_request": "post_loan_disbursal_query_pay_2",
    "predisbursal_loan_query_general_info": "predisbursal_loan_query_general",
    "predisbursal_loan_query_im+_instances": "predisbursal_loan_query_im_in_1",
    "predisbursal_loan_query_incomplete_profile": "predisbursal_loan_query_incompl",
    "predisbursal_loan_query_loan_approved_disbursal_in_progress": "predisbursal_loan_approved_disb",
    "stop_marketing_sms-emails_details_added_in_the_sheet_": "stop_marketing_sms_emails_detai",
    "unregistered-no_content_registered_credentials_needed": "unregistered_no_content_registe",
    "collection_queries_settlement_query": "collection_queries_settlement_q",
    "post_loan_closure_queries_credit_report_issues": "post_loan_closure_queries_credi",
    "post_loan_closure_queries_loan_related_documents_required_": "post_loan_closure_queries_loan",
    "predisbursal_loan_query_kyc_issue_pan-aadhar_exists": "predisbursal_loan_query_kyc_iss",
    "predisbursal_loan_query_nach_issue_general_information": "predisbursal_loan_query_nach_is",
    "predisbursal_loan_query_nach_issue_unable_to_proceed_enach": "predisbursal_loan_query_nach_1",
    "predisbursal_loan_query_rf-vf_query_general_information": "predisbursal_loan_query_rf_vf_q",
    "predisbursal_loan_query_rf-vf_query_rf-vf_paid_not_updated": "predisbursal_loan_query_rf_vf_p",
    "rejected_loan_cancel_enach_": "rejected_loan_cancel_enach",
    "rejected_loan_checking_for_reason": "rejected_loan_checking_for_reas",
    "rejected_loan_requesting_for_refund_": "rejected_loan_requesting_for_re",
    "rejected_loan_wants_to_re-apply-re-consider": "rejected_loan_wants_to_re_apply",
    "update_-_edit_details_address": "update_edit_details_address",
    "update_-_edit_details_name": "update_edit_details_name",
}

# Categories answered without a search.
SKIPPED_CATEGORIES = [
    "post_loan_disbursal_query_payment_lndn_payment_",
    "predisbursal_loan_query_rf/vf_query_general_information",
    "escalations_rbi-cyber_cell_",
    "escalations_singledebt_",
    "post_loan_disbursal_query_payment_paytm_payment_not_updated",
    "other_kyc_issues",
    "predisbursal_loan_query_im+_instances_unable_to_place_withdrawal",
]


def status_list(loan: Column, repayment: Column, lr: Column) -> Column:
    """The usable loan and repayment values, or the lr value when there is neither."""
    main = F.array_compact(F.array(nullish(loan), nullish(repayment)))
    return F.when(F.size(main) > 0, main).otherwise(F.array_compact(F.array(nullish(lr))))


def last_status(loan: Column, repayment: Column, lr: Column, words: list[str]) -> Column:
    """The last value of the status list that is one of ``words``, in lower case; '' when there is none.

    Takes cleaned values (NULL for missing) and needs no list: the repayment value
    comes after the loan value, and the lr value counts only without both.
    """
    only_lr = loan.isNull() & repayment.isNull()
    found = F.when(repayment.isin(words), repayment).when(loan.isin(words), loan).when(only_lr & lr.isin(words), lr)
    return F.lower(F.coalesce(found, F.lit("")))


def status_key(im: Column, loan: Column, repayment: Column, no_status: Column) -> Column:
    """The status key of a ticket from its product value and its two status words."""
    plain_product = im.isin("IM", "IM+")
    word = (
        F.when(no_status, "nostatus")
        .when(loan == "", F.when(plain_product, "nostatus").otherwise("_nostatus"))
        .when(plain_product & (loan == "under_review"), "underreview")
        .when(plain_product & (loan != "disbursed"), loan)
        .otherwise(F.concat(loan, repayment))
    )
    return F.concat(F.lower(F.replace(im, F.lit("+"), F.lit("_"))), word)


def with_status_words(tickets: DataFrame) -> DataFrame:
    """``tickets`` with ``im``, ``loan``, ``repayment`` and ``no_status``.

    In two steps, so that each cleaned value is computed once and not in every branch
    that reads it.
    """
    cleaned = tickets.withColumns(
        {
            "im": nullish(F.col("data_from")),
            "_ls": nullish(F.col("loan_status")),
            "_rs": nullish(F.col("repayment_status")),
            "_lr": nullish(F.col("lr_status")),
        }
    )
    values = [F.col(c) for c in ("_ls", "_rs", "_lr")]
    return cleaned.withColumns(
        {
            "loan": last_status(*values, LOAN_STATUSES),
            "repayment": last_status(*values, REPAYMENT_STATUSES),
            "no_status": F.coalesce(*values).isNull(),
        }
    ).drop("_ls", "_rs", "_lr")


def strip_number(status: Column) -> Column:
    """Without a trailing ``_<digits>``."""
    return F.regexp_replace(status, "_[0-9]+$", "")


def direct_status(lr: Column, compat: bool = True) -> Column:
    """Status of a ticket without a product value: its lr value as it is."""
    return F.coalesce(strip(lr), F.lit("nan" if compat else NOT_FOUND))


def with_status(tickets: DataFrame, compat: bool = True) -> DataFrame:
    """``tickets`` with ``status``."""
    words = with_status_words(tickets)
    keyed = status_key(F.col("im"), F.col("loan"), F.col("repayment"), F.col("no_status"))
    chosen = F.when(F.col("im").isNotNull(), keyed).otherwise(direct_status(F.col("lr_status"), compat))
    return words.withColumn("status", strip_number(chosen)).drop("im", "loan", "repayment", "no_status")


def lower_category(raw: Column, compat: bool = True) -> Column:
    return F.coalesce(F.lower(raw), F.lit("nan" if compat else NOT_FOUND))


def map_category(category: Column, pairs: dict[str, str] | None = None, keep: bool = True) -> Column:
    """Collection name of a category by the fixed map; else the category itself, or NULL without ``keep``."""
    fixed = CATEGORY_MAP if pairs is None else pairs
    literal = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
    mapped = F.try_element_at(literal, category)
    return F.coalesce(mapped, category) if keep else mapped


def remap_status(status: Column) -> Column:
    return F.when(status == "im_closed", "imclosed").otherwise(status)


def remap_category(category: Column) -> Column:
    """Two categories renamed ahead of the map."""
    return (
        F.when(category == "predisbursal_loan_query_im+_instances", "predisbursal_loan_query_im_in_1")
        .when(category == "update_-_edit_details_bank_account_details_", "update_edit_details_bank_accou")
        .otherwise(category)
    )
