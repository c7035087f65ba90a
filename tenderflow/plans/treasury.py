"""Daily treasury totals, for stores without and with a smart safe."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.operators import (
    business_dates,
    by_eligibility,
    scalar_lookup,
)
from tenderflow.params import ReportParams
from tenderflow.plans.change_fund import known_stores
from tenderflow.plans.over_short import (
    asked_ends,
    count_differences,
    of_sessions,
    safe_differences,
)
from tenderflow.plans.shared import Shared, Tables, once, run_of
from tenderflow.plans.tenders import (
    asked_lines,
    bag_references,
    deposit_listings,
    listing_references,
    ordered_with_listings,
    posted_elsewhere,
    tender_payments,
    typed_lines,
    with_traits,
)

ORDER = ["locationid", "department"]


def columns(reference: str) -> list[Column]:
    return [
        F.col("locationid"), F.col("amount"), F.col("trans_date"), F.col("department"),
        F.col("billerid"), F.col("payment_type"), F.col("deposit_ref").alias(reference),
    ]


@dataclass(frozen=True)
class Asked:
    """The driving rows of a run: typed tender lines, the amounts posted for them on any date,
    and end counts of known sessions; and the business dates these have.

    Every branch starts from them several times, so they are stored once for all branches and all
    statements of a run, and a statement takes its stores of them.  They are the run's days of two
    tables; all else is read for their business dates.
    """

    lines: DataFrame
    posted: DataFrame
    line_dates: list[date]
    ends: DataFrame
    end_dates: list[date]

    @classmethod
    def of(cls, tables: Shared, params: ReportParams, safe: bool | None = None) -> Asked:
        def typed() -> DataFrame:
            raw = asked_lines(tables, params)
            dates = business_dates(raw)
            return with_traits(tables, params, typed_lines(tables, params, raw, dates), dates)

        lines = once(tables, "lines", params, typed)
        posted = once(
            tables, "posted", params, lambda: posted_elsewhere(tables, params, lines)
        )
        ends = once(
            tables, "ends", params, lambda: of_sessions(tables, asked_ends(tables, params))
        )
        line_dates, end_dates = business_dates(lines), business_dates(ends)
        if safe is not None:
            # the treasury asks for the stores of its finished rows; every branch keeps rows of
            # different stores apart, so the filter runs here already
            eligible = known_stores(tables, params)
            lines = by_eligibility(lines, eligible, safe, params.codes)
            ends = by_eligibility(ends, eligible, safe, params.codes)
        return cls(lines, posted, line_dates, ends, end_dates)


@dataclass(frozen=True)
class Branches:
    """Parts of a statement by name, and the texts of references that stand for a listing, by
    the departments whose rows can name them."""

    parts: dict[str, DataFrame]
    texts: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)
    #: whether rows of different parts always differ, by their departments
    apart: bool = False

    def shown(self, rows: DataFrame) -> DataFrame:
        """Rows with the texts of listings, then by store and department."""
        return ordered_with_listings(rows, ORDER, self.texts) if self.texts else rows

    def keyed(self) -> DataFrame:
        """Union of all parts, with the keys of listings; equal rows are kept once."""
        if self.apart:
            return reduce(DataFrame.unionByName, [one.distinct() for one in self.parts.values()])
        return reduce(DataFrame.unionByName, self.parts.values()).distinct()

    def merged(self) -> DataFrame:
        """The same with the texts of listings."""
        return self.shown(self.keyed())


def treasury_branches(
    tables: Tables, params: ReportParams, asked: Asked | None = None, named: bool = False
) -> Branches:
    """Parts of the statement without safes; for all stores unless ``asked`` limits them.

    With ``named``, rows have the number of their user.
    """
    tables = run_of(tables)
    asked = asked or Asked.of(tables, params)
    dates = asked.line_dates
    attach = bag_references(tables, dates)
    differences = count_differences(tables, params, asked.ends, asked.end_dates)
    codes = params.codes
    return Branches(
        {
            "payments": tender_payments(
                tables, params, asked.lines, asked.posted, dates, attach,
                partial(_named, tables) if named else None,
            ),
            "over_short": _named(tables, differences) if named else differences,
        },
        apart=codes.over_short not in (codes.core, codes.device, codes.service, codes.accessory),
    )


def smartsafe_branches(
    tables: Tables, params: ReportParams, asked: Asked | None = None
) -> Branches:
    tables = run_of(tables)
    asked = asked or Asked.of(tables, params)
    dates = asked.line_dates
    listings = once(
        tables, "listings", params, lambda: deposit_listings(tables, params, dates)
    )
    attach, store_texts = listing_references(listings)
    differences, texts = safe_differences(tables, params, asked.ends, asked.end_dates)
    payments = tender_payments(tables, params, asked.lines, asked.posted, dates, attach)
    codes = params.codes
    paid = (codes.core, codes.device, codes.service, codes.accessory)
    return Branches(
        {"payments": payments, "over_short": differences},
        {paid: store_texts, (codes.over_short,): texts},
    )


def treasury(tables: Tables, params: ReportParams) -> DataFrame:
    return treasury_rows(tables, params).orderBy(*ORDER)


def treasury_rows(tables: Tables, params: ReportParams) -> DataFrame:
    tables = run_of(tables)
    asked = Asked.of(tables, params, safe=False)
    branches = treasury_branches(tables, params, asked, named=True)
    return branches.keyed().select(*columns("bag_id"), "pid")


def smartsafe_treasury(tables: Tables, params: ReportParams) -> DataFrame:
    return smartsafe_rows(tables, params)


def keyed_smartsafe(tables: Tables, params: ReportParams) -> tuple[DataFrame, DataFrame]:
    """The same rows in the same order with the keys of listings, and the listings by key.

    Each row of a store and day names the listing of all its deposits, so rows with their texts
    grow as the square of a day's deposits; these two grow with them.
    """
    branches, named = _smartsafe(tables, params)
    rows = named.select(*columns("deposits"), "pid").orderBy(*ORDER)
    texts = reduce(DataFrame.unionByName, branches.texts.values())
    return rows, texts.select(F.col("listing_key").alias("deposits"), "listing")


def smartsafe_rows(tables: Tables, params: ReportParams) -> DataFrame:
    branches, named = _smartsafe(tables, params)
    return branches.shown(named).select(*columns("deposits"), "pid")


def _smartsafe(tables: Tables, params: ReportParams) -> tuple[Branches, DataFrame]:
    tables = run_of(tables)
    branches = smartsafe_branches(tables, params, Asked.of(tables, params, safe=True))
    return branches, _named(tables, branches.keyed())


def _named(tables: Tables, rows: DataFrame) -> DataFrame:
    """Rows with the number of their user."""
    return scalar_lookup(
        rows, tables["hrs_employee"], {"create_user_id": "party_id"},
        {"pid": F.col("employee_id")},
    )
