"""All days of a range in one job, each row with the date of the run it belongs to.

Every report keeps its day in its group keys already, so a range is the report over a longer
window; only the weekly report needs run dates of its own, as its window is longer than a day.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.params import ACH_FIRST_LAG, ACH_LAST_LAG, ReportParams, Window
from tenderflow.plans.ach import COLUMNS as ACH_COLUMNS
from tenderflow.plans.ach import daily_checks
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.kiosk import kiosk_reconcile
from tenderflow.plans.shared import Tables
from tenderflow.plans.till_variance import COLUMNS as TILL_COLUMNS
from tenderflow.plans.till_variance import variances
from tenderflow.plans.treasury import smartsafe_rows, treasury_rows


def backfill(report: str, tables: Tables, params: ReportParams) -> DataFrame:
    """Rows of ``report`` for every day of ``params.window``, with their ``report_date``.

    For the weekly report the window holds the run dates: one run every seven days from its
    start on.
    """
    return _BACKFILL[report](tables, params)


def _from_text(build, pattern: str):
    def rows(tables: Tables, params: ReportParams) -> DataFrame:
        return build(tables, params).withColumn("report_date", F.to_date("trans_date", pattern))

    return rows


def _till(tables: Tables, params: ReportParams) -> DataFrame:
    days = F.col("day").alias("report_date")
    return variances(tables, params).select(*TILL_COLUMNS, days).distinct()


def _ach(tables: Tables, params: ReportParams, step: int = 7) -> DataFrame:
    """Each day's rows go to the runs whose window holds it, after they are added up."""
    first, last = params.window.start, params.window.end
    covered = Window(
        first - timedelta(days=ACH_FIRST_LAG), last - timedelta(days=ACH_LAST_LAG)
    )
    after = F.date_diff(F.col("day"), F.lit(first))
    from_run = F.greatest(F.ceil((after + ACH_LAST_LAG) / step), F.lit(0))
    to_run = F.least(
        F.floor((after + ACH_FIRST_LAG) / step), F.lit((last - first).days // step)
    )
    runs = F.when(from_run <= to_run, F.sequence(from_run, to_run))
    daily = daily_checks(tables, replace(params, window=covered))
    return daily.withColumn("run", F.explode(runs)).select(
        *ACH_COLUMNS,
        F.date_add(F.lit(first), (F.col("run") * step).cast("int")).alias("report_date"),
    )


_BACKFILL = {
    "treasury": _from_text(treasury_rows, "yyyyMMdd"),
    "smartsafe_treasury": _from_text(smartsafe_rows, "yyyyMMdd"),
    "change_fund": _from_text(change_fund, "yyyy-MM-dd"),
    "kiosk_reconcile": _from_text(kiosk_reconcile, "yyyy-MM-dd"),
    "till_variance": _till,
    "ach_checks": _ach,
}
