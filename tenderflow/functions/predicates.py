"""Filters, written so that as much as possible reaches the scan."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderflow.codes import Codes
from tenderflow.params import ReportParams, Window

__all__ = [
    "asked_rows", "code_like", "created_within", "dated_within", "is_service_sale",
    "is_accessory_sale", "is_core_sale", "is_device_sale", "posts_amount", "store_matches",
]


def created_within(moment: Column, window: Window) -> Column:
    """Half-open range on the raw timestamp, so file statistics can be used."""
    first = F.lit(window.start).cast("timestamp")
    after = F.lit(window.end + timedelta(days=1)).cast("timestamp")
    return (moment >= first) & (moment < after)


def dated_within(day: Column, window: Window) -> Column:
    return day.between(F.lit(window.start), F.lit(window.end))


def code_like(code: Column, prefix: str) -> Column:
    """LIKE 'prefix%', where ``_`` stays a wildcard.

    A pattern with a wildcard inside is not pushed to the scan, so the part before the first
    one is tested as well.
    """
    literal = prefix.split("_")[0].split("%")[0]
    like = code.like(f"{prefix}%")
    return code.startswith(literal) & like if literal else like


def store_matches(store: Column, pattern: str | None) -> Column:
    return store.isNotNull() if pattern is None else store.cast("string").like(pattern)


def asked_rows(params: ReportParams) -> Column:
    """Rows of a table with a creation time that belong to the run."""
    return (
        created_within(F.col("create_date"), params.window)
        & (F.col("organization_id") == params.organization_id)
        & store_matches(F.col("rtl_loc_id"), params.store_pattern)
    )


def posts_amount(code: Column, tender_id: Column, codes: Codes) -> Column:
    """The plain posted-amount property counts for ACH only; numbered ones count for all."""
    plain = code == codes.posted_amount
    return (plain & (tender_id == codes.ach_tender)) | (
        (code != codes.posted_amount) & code_like(code, codes.posted_amount)
    )


def is_core_sale(item: Column, codes: Codes) -> Column:
    return ~item.isin(codes.device_item, codes.service_item)


def is_device_sale(item: Column, scanned: Column, codes: Codes) -> Column:
    return (item == codes.device_item) & ~scanned.isin(codes.biller_item, codes.service_item)


def is_service_sale(scanned: Column, codes: Codes) -> Column:
    return scanned == codes.service_item


def is_accessory_sale(merchandise_class: Column, codes: Codes) -> Column:
    return merchandise_class != codes.non_payable_class
