"""Change fund orders of stores with a smart safe."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import code_like, iso_day_text
from tenderflow.operators import (
    asked,
    business_dates,
    by_eligibility,
    eligible_stores,
    on_dates,
    ordered_listing,
)
from tenderflow.params import ReportParams
from tenderflow.plans.shared import Tables, once
from tenderflow.schemas import TXN_KEY


def control_transactions(
    tables: Tables, params: ReportParams, statuses: list[str]
) -> tuple[DataFrame, list[date]]:
    """The asked-for control transactions of eligible stores, and the business dates they have."""
    codes = params.codes

    def build() -> DataFrame:
        return asked(tables, "trn_trans", params).filter(
            F.col("trans_typcode") == codes.control_transaction
        ).select(*TXN_KEY, "create_date", "trans_statcode")

    controls = once(tables, "control_transactions", params, build).filter(
        F.col("trans_statcode").isin(*statuses)
    )
    transactions = by_eligibility(controls, known_stores(tables, params), True, codes)
    return transactions.drop("trans_statcode"), business_dates(controls)


def known_stores(tables: Tables, params: ReportParams) -> DataFrame:
    """The eligible stores, found once in a run."""
    return once(
        tables, "eligible_stores", params.codes, lambda: eligible_stores(tables, params.codes)
    )


def change_fund(tables: Tables, params: ReportParams) -> DataFrame:
    codes = params.codes
    transactions, dates = control_transactions(tables, params, [codes.complete])
    adjustments = on_dates(tables["tsn_tndr_control_trans"], dates).filter(
        (F.col("typcode") == codes.bag_adjustment)
        & (F.col("inbound_tndr_repository_id") == codes.change_fund)
    )
    counts = on_dates(tables["tsn_tndr_tndr_count"], dates)
    notes = on_dates(tables["trn_trans_notes"], dates)
    deposits = ordered_listing(
        on_dates(tables["trn_trans_p"], dates).filter(
            code_like(F.col("property_code"), codes.deposit_id)
        ),
        TXN_KEY, "string_value", "smartsafe_transaction#",
    )
    return (
        transactions
        .join(adjustments.select(*TXN_KEY, "reascode"), TXN_KEY)
        .join(counts.select(*TXN_KEY, "amt", "deposit_amt", "difference_amt"), TXN_KEY)
        .join(notes, TXN_KEY, "left")
        .join(deposits, TXN_KEY, "left")
        .select(
            iso_day_text(F.col("create_date")).alias("trans_date"),
            F.col("rtl_loc_id").alias("store#"),
            F.col("amt").alias("change_fund_order_amount_received"),
            F.col("deposit_amt").alias("amount_deposited"),
            "`smartsafe_transaction#`",
            F.col("difference_amt").alias("variance"),
            F.col("reascode").alias("reason_code"),
            F.col("note").alias("comments"),
        )
    )
