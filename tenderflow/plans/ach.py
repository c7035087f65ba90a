"""ACH check transactions per store and business date."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import dated_within, us_day_text
from tenderflow.params import ReportParams
from tenderflow.schemas import TOTAL

COLUMNS = [
    "store", "store_name", "address1", "state", "city", "district", "postal_code",
    "business_date", "achtransactions", "sum",
]
ORDER = ["store", "business_date"]


def ach_checks(tables: Mapping[str, DataFrame], params: ReportParams) -> DataFrame:
    """Count and sum of ACH tenders; stores and dates that add up to zero are left out.

    Tender lines are added up per store and date before they meet the store table; a store
    listed several times with one address counts its lines as often.
    """
    return daily_checks(tables, params).select(*COLUMNS).orderBy(*ORDER)


def daily_checks(tables: Mapping[str, DataFrame], params: ReportParams) -> DataFrame:
    """The report rows, unordered, with the date itself as ``day``."""
    lines = (
        tables["ttr_tndr_lineitm"]
        .filter(F.col("tndr_id") == params.codes.ach_tender)
        .filter(dated_within(F.col("business_date"), params.window))
    )
    daily = lines.groupBy("rtl_loc_id", F.col("business_date").alias("day")).agg(
        F.count("tndr_id").alias("lines"), F.sum("amt").alias("total")
    )
    address = ["store_name", "address1", "state", "city", "district", "postal_code"]
    stores = (
        tables["loc_rtl_loc"].groupBy("rtl_loc_id", *address).agg(F.count("*").alias("listed"))
    )
    return (
        daily.filter(F.col("total") != 0)
        .join(stores, "rtl_loc_id")
        .select(
            F.col("rtl_loc_id").alias("store"), *address,
            us_day_text(F.col("day")).alias("business_date"),
            (F.col("lines") * F.col("listed")).alias("achtransactions"),
            (F.col("total") * F.col("listed")).cast(TOTAL).alias("sum"),
            "day",
        )
    )
