"""Report windows, cell rendering, output paths and the scheduled runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.checks.register import AS_OF_DAILY, AS_OF_WEEKLY, DAY, WEEK, check
from tenderflow.checks.statements import (
    _ach_sql,
    _change_fund_sql,
    _kiosk_sql,
    _report_sql,
    _till_sql,
)
from tenderflow.params import (
    ReportParams,
    Window,
    ach_window,
    daily_window,
    till_window,
)
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.bundle import manifest, run_bundle
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.registry import STATEMENTS
from tenderflow.sinks import DAILY, WEEKLY, output_path, render_cells, write_report
from tenderflow.sources.staging import staging_folder


@check("prm_report_windows", """
    select distinct cast(create_date as date) as as_of,
        cast(create_date as date) - 2 as report_day, cast(create_date as date) - 1 as till_day,
        cast(create_date as date) - 7 as ach_start, cast(create_date as date) - 1 as ach_end
    from trn_trans
""")
def report_windows(t):
    """Windows of a run on each day that has transactions."""
    some = date(2024, 6, 1)
    asked = {
        "report_day": daily_window(some).end, "till_day": till_window(some).start,
        "ach_start": ach_window(some).start, "ach_end": ach_window(some).end,
    }
    days = t["trn_trans"].select(F.to_date("create_date").alias("as_of")).distinct()
    return days.withColumns({
        name: F.date_sub("as_of", (some - day).days) for name, day in asked.items()
    })


@check("snk_render_cells", f"""
    select cast(store as varchar) as store, store_name, address1, state, city, district,
        postal_code, business_date, cast(achtransactions as varchar) as achtransactions,
        regexp_replace(regexp_replace(cast("sum" as varchar), '0+$', ''), '\\.$', '') as "sum"
    from ({_ach_sql("date '2024-01-01'", "date '2024-01-07'")})
""")
def cells(t):
    return render_cells(ach_checks(t, WEEK))


@check("snk_output_paths", """
    with run as (select distinct business_date as as_of from trn_trans)
    select as_of, report,
        'report=' || report || '/as_of=' || strftime(as_of, '%d_%B_%Y') as path
    from run, (values ('till_variance'), ('change_fund'), ('kiosk_reconcile'), ('treasury'),
        ('smartsafe_treasury')) v(report)
    union all
    select as_of, report, 'report=' || report || '/as_of=' || strftime(as_of, '%B_%Y')
    from run, (values ('ach_checks')) v(report)
""")
def output_paths(t):
    """Where a run on each business date writes its statements."""
    runs = t["trn_trans"].select(F.col("business_date").alias("as_of")).distinct()

    def paths(period: str) -> DataFrame:
        names = [F.lit(name) for name, report in STATEMENTS.items() if report.period == period]
        named = runs.withColumn("report", F.explode(F.array(*names)))
        path = output_path(F.col("report"), F.col("as_of"), period)
        return named.withColumn("path", path)

    return paths(DAILY).unionByName(paths(WEEKLY))


_EMPTY = ReportParams(Window.day(date(2030, 1, 1)))
_TEXT_COLUMNS = [
    "trans_date", "store#", "change_fund_order_amount_received", "amount_deposited",
    "smartsafe_transaction#", "variance", "reason_code", "comments",
]


_AMOUNTS = {"change_fund_order_amount_received", "amount_deposited", "variance"}


def _as_text(source: str, kind: str) -> str:
    def cell(name: str) -> str:
        text = f'cast("{name}" as varchar)'
        if name in _AMOUNTS:
            text = f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '')"
        return f'{text} as "{name}"'

    cells = ", ".join(cell(name) for name in _TEXT_COLUMNS)
    return f"select '{kind}' as run, {cells} from ({source})"


@check("snk_placeholder", f"""
    {_as_text(_change_fund_sql(DAY.window), "filled")}
    union all
    select 'filled', 'No data available for the selected date.',
        null, null, null, null, null, null, null
    where not exists ({_change_fund_sql(DAY.window)})
    union all
    {_as_text(_change_fund_sql(_EMPTY.window), "empty")}
    union all
    select 'empty', 'No data available for the selected date.',
        null, null, null, null, null, null, null
    where not exists ({_change_fund_sql(_EMPTY.window)})
""")
def placeholder(t):
    def run(params: ReportParams, kind: str) -> DataFrame:
        """What a run writes, read again."""
        path = staging_folder(t.spark, kind)
        rows = change_fund(t, params)
        write_report(rows, path, fmt="parquet", placeholder=True)
        written = t.spark.read.parquet(path)
        return written.select(F.lit(kind).alias("run"), *[
            F.col(f"`{name}`").cast("string").alias(name) for name in rows.columns
        ])

    return run(DAY, "filled").unionByName(run(_EMPTY, "empty"))


def _run(t, as_of: date, period: str) -> DataFrame:
    return run_bundle(t.spark, t, as_of, period, staging_folder(t.spark, period))


def _status_sql(name: str, window: Window, label: str, source: str, more: str = "") -> str:
    return f"""
        select '{name}' as report, 'report={name}/as_of={label}' as path,
            date '{window.start}' as window_start, date '{window.end}' as window_end,
            (select count(*) from ({source})) as row_count{more}"""


def _daily_sql(more: str = "", only: tuple[str, ...] = ()) -> str:
    day, till = daily_window(AS_OF_DAILY), till_window(AS_OF_DAILY)
    sources = {
        "till_variance": (till, _till_sql(till)),
        "change_fund": (day, _change_fund_sql(day)),
        "kiosk_reconcile": (day, _kiosk_sql(day)),
        "treasury": (day, _report_sql(day, safe=False)),
        "smartsafe_treasury": (day, _report_sql(day, safe=True)),
    }
    return " union all ".join(
        _status_sql(name, window, "05_January_2024", source, more)
        for name, (window, source) in sources.items() if not only or name in only
    )


_OUTCOME = ", true as ok, 'written' as message"


@check("bundle_status_daily", _daily_sql(_OUTCOME))
def status_daily(t):
    return _run(t, AS_OF_DAILY, DAILY)


def _weekly_sql(more: str = "") -> str:
    window = ach_window(AS_OF_WEEKLY)
    source = _ach_sql(f"date '{window.start}'", f"date '{window.end}'")
    return _status_sql("ach_checks", window, "January_2024", source, more)


@check("bundle_status_weekly", _weekly_sql(_OUTCOME))
def status_weekly(t):
    return _run(t, AS_OF_WEEKLY, WEEKLY)


@check("bundle_manifest", " union all ".join([
    _daily_sql(only=("change_fund", "kiosk_reconcile", "treasury", "smartsafe_treasury")),
    _weekly_sql(),
]))
def manifests(t):
    daily = manifest(_run(t, AS_OF_DAILY, DAILY))
    return daily.unionByName(manifest(_run(t, AS_OF_WEEKLY, WEEKLY)))
