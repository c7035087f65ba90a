"""Cash differences of till end counts and bank deposits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import (
    dated_within,
    full_name,
    minute_text,
    month_name_day_text,
    till_label,
)
from tenderflow.operators import scalar_lookup, session_matches
from tenderflow.params import ReportParams
from tenderflow.schemas import STORE_TXN_KEY, TXN_KEY

COLUMNS = [
    "store", "store_name", "store_address", "business_date", "till_number", "pid",
    "employee_name", "expected_amt", "actual_amt", "variance", "reascode", "comments",
    "create_date",
]
ORDER = ["store", "till_number"]


def till_variance(tables: Mapping[str, DataFrame], params: ReportParams) -> DataFrame:
    return variances(tables, params).select(*COLUMNS).distinct().orderBy(*ORDER)


def variances(tables: Mapping[str, DataFrame], params: ReportParams) -> DataFrame:
    """One row per counted difference, before equal rows are merged, with the date as ``day``.

    The session only has to exist and the result is distinct, so sessions are a semi join.
    """
    codes = params.codes
    dated = dated_within(F.col("business_date"), params.window)
    controls = tables["tsn_tndr_control_trans"].filter(
        dated & F.upper("typcode").isin(codes.end_count, codes.bank_deposit)
    )
    controls = session_matches(
        controls.select(
            *TXN_KEY, "outbound_tndr_repository_id", "outbound_session_id",
            "inbound_session_id", "reascode", "create_date",
        ),
        tables["tsn_session"], "left_semi",
    )
    counts = tables["tsn_tndr_tndr_count"].filter(
        dated
        & (F.col("tndr_typcode") == codes.cash_type)
        & (F.col("tndr_id") == codes.cash_tender)
        & (F.col("difference_amt") != 0)
    )
    tenders = tables["tnd_tndr"].select("organization_id", "tndr_id")
    counted = controls.join(
        counts.select(*TXN_KEY, "tndr_id", "amt", "difference_amt", "create_user_id"), TXN_KEY
    ).join(tenders, ["organization_id", "tndr_id"], "left_semi")

    named = scalar_lookup(
        counted, tables["loc_rtl_loc"], {"rtl_loc_id": "rtl_loc_id"},
        {"store_name": F.col("store_name"), "store_address": F.col("address1")},
        distinct=True,
    )
    named = scalar_lookup(
        named, tables["crm_party"], {"create_user_id": "party_id"},
        {
            "pid": F.col("employee_id"),
            "employee_name": full_name(F.col("first_name"), F.col("last_name")),
        },
    )
    noted = scalar_lookup(
        named, tables["trn_trans_notes"].filter(dated), {key: key for key in STORE_TXN_KEY},
        {"comments": F.col("note")},
    )
    return noted.select(
        F.col("rtl_loc_id").alias("store"), "store_name", "store_address",
        month_name_day_text(F.col("business_date")).alias("business_date"),
        till_label(F.col("outbound_tndr_repository_id"), codes).alias("till_number"),
        "pid", "employee_name",
        (F.col("amt") - F.col("difference_amt")).alias("expected_amt"),
        F.col("amt").alias("actual_amt"),
        F.col("difference_amt").alias("variance"),
        "reascode", "comments",
        minute_text(F.col("create_date")).alias("create_date"),
        F.col("business_date").alias("day"),
    )
