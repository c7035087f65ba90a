"""Column expressions.  Every one stays inside generated code; there are no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderflow.codes import Codes

__all__ = [
    "blank_as_null", "day_text", "deposit_only", "first8", "full_name", "is_deposit",
    "iso_day_text", "minute_text", "month_name_day_text", "nth_run", "payment_type",
    "scope_store", "till_label", "us_day_text",
]


def is_deposit(tender_type: Column, tender_id: Column, codes: Codes) -> Column:
    """Neither credit nor ACH.  An unknown tender type is not a deposit."""
    known = (tender_type != codes.credit_type) & (tender_id != codes.ach_tender)
    return F.coalesce(known, F.lit(False))


def payment_type(tender_type: Column, tender_id: Column, codes: Codes) -> Column:
    """Deposit label, the ACH tender's own id, or else the tender type (may be NULL)."""
    not_credit = tender_type != codes.credit_type
    return (
        F.when(is_deposit(tender_type, tender_id, codes), F.lit(codes.deposit_label))
        .when(not_credit & (tender_id == codes.ach_tender), tender_id)
        .otherwise(tender_type)
    )


def deposit_only(deposit: Column, reference: Column) -> Column:
    return F.when(deposit, reference)


def till_label(repository: Column, codes: Codes) -> Column:
    return (
        F.when(repository.isNull(), F.lit(codes.store_bank_label))
        .when(repository == codes.store_bank, F.lit(codes.bank_deposit_label))
        .otherwise(repository)
    )


def first8(text: Column) -> Column:
    return F.substring(text, 1, 8)


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def scope_store(scope: Column, codes: Codes) -> Column:
    """Store number inside a deployment scope; the source treats empty text as NULL."""
    return blank_as_null(F.replace(scope, F.lit(codes.scope_prefix), F.lit("")))


def full_name(first: Column, last: Column) -> Column:
    """Names joined by one blank; a missing part counts as empty text."""
    return F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))


def nth_run(text: Column, separator: str, n: int) -> Column:
    """n-th run of characters other than ``separator`` (1-based), NULL when there are fewer."""
    return F.get(F.regexp_extract_all(text, F.lit(f"[^{separator}]+"), F.lit(0)), n - 1)


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd")


def iso_day_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def us_day_text(moment: Column) -> Column:
    return F.date_format(moment, "MM/dd/yyyy")


def month_name_day_text(moment: Column) -> Column:
    return F.upper(F.date_format(moment, "dd-MMM-yyyy"))


def minute_text(moment: Column) -> Column:
    return F.upper(F.date_format(moment, "dd-MMM-yyyy HH:mm"))
