"""The six statements and how their scheduled runs use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from tenderflow.params import ReportParams, Window, ach_window, daily_window, till_window
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.kiosk import kiosk_reconcile
from tenderflow.plans.shared import Tables
from tenderflow.plans.till_variance import till_variance
from tenderflow.plans.treasury import keyed_smartsafe, smartsafe_treasury, treasury
from tenderflow.sinks import DAILY, WEEKLY


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[[Tables, ReportParams], DataFrame]
    window: Callable[[date], Window]
    period: str
    #: an empty run leaves a note instead of an empty output
    placeholder: bool
    #: listed in the manifest
    delivered: bool
    #: the same rows with keys in a column, and the long texts of that column by key
    keyed: Callable[[Tables, ReportParams], tuple[DataFrame, DataFrame]] | None = None


# The order of the scheduled runs, and which statements are noted and delivered.
STATEMENTS = {
    report.name: report
    for report in (
        Report("till_variance", till_variance, till_window, DAILY, False, False),
        Report("change_fund", change_fund, daily_window, DAILY, True, True),
        Report("kiosk_reconcile", kiosk_reconcile, daily_window, DAILY, False, True),
        Report("treasury", treasury, daily_window, DAILY, False, True),
        Report(
            "smartsafe_treasury", smartsafe_treasury, daily_window, DAILY, True, True,
            keyed=keyed_smartsafe,
        ),
        Report("ach_checks", ach_checks, ach_window, WEEKLY, True, True),
    )
}


def statements_of(period: str) -> list[Report]:
    return [report for report in STATEMENTS.values() if report.period == period]
