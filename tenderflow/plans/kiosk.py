"""Kiosk reconciliation: what the till expected against what the safe took in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import iso_day_text
from tenderflow.operators import on_dates, property_summary
from tenderflow.params import ReportParams
from tenderflow.plans.change_fund import control_transactions
from tenderflow.plans.shared import Tables
from tenderflow.schemas import TOTAL, TXN_KEY


def kiosk_reconcile(tables: Tables, params: ReportParams) -> DataFrame:
    codes = params.codes
    transactions, dates = control_transactions(tables, params, [codes.new, codes.complete])
    counts = on_dates(tables["tsn_tndr_control_trans"], dates).filter(
        (F.col("typcode") == codes.end_count)
        & (F.col("outbound_tndr_repository_id") == codes.kiosk_repository)
    )
    safe = property_summary(
        on_dates(tables["trn_trans_p"], dates), TXN_KEY,
        listed={"deposits": codes.deposit_id, "batch_number": codes.batch_number},
        summed={"deposited": codes.deposit_amount},
    )
    notes = on_dates(tables["trn_trans_notes"], dates)
    deposited = F.col("deposited").cast(TOTAL)
    return (
        transactions
        .join(counts.select(*TXN_KEY, "amt", "reascode"), TXN_KEY)
        .join(notes, TXN_KEY, "left")
        .join(safe, TXN_KEY, "left")
        .select(
            iso_day_text(F.col("create_date")).alias("trans_date"),
            F.col("rtl_loc_id").alias("store#"),
            F.col("amt").alias("amount_expected"),
            deposited.alias("deposited_amount"),
            (F.col("amt") - deposited).cast(TOTAL).alias("variance"),
            F.col("deposits").alias("smartsafe_transaction#"),
            F.col("reascode").alias("variance_reason_code"),
            "batch_number",
            F.col("note").alias("comments"),
        )
    )
