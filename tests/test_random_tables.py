"""Statements on random tables against SQL that joins row by row.

The tables repeat keys, mix organizations and dates, and hold NULLs, so every count that
stands for a fan-out has to be right.
"""

import pytest
from literal import DAY, duck_rows, duck_tables, random_rows, spark_rows, spark_tables

from tenderflow.checks import statements
from tenderflow.checks.register import WEEK
from tenderflow.operators import eligible_stores
from tenderflow.params import ReportParams, Window
from tenderflow.plans import treasury as plan
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.kiosk import kiosk_reconcile
from tenderflow.plans.till_variance import till_variance

PARAMS = ReportParams(Window.day(DAY))


@pytest.fixture(scope="module", params=[2, 8, 11])
def both(request, spark):
    rows = random_rows(request.param)
    return spark_tables(spark, rows), duck_tables(rows)


def same(df, connection, sql):
    names, want = duck_rows(connection, sql)
    order, got = spark_rows(df)
    assert order == names
    assert got == want
    return sum(got.values())


def test_eligible_stores(both):
    tables, connection = both
    sql = "select nullif(rtl_loc_id, '') as rtl_loc_id from safe_store"
    same(eligible_stores(tables), connection, sql)


def test_small_statements(both):
    tables, connection = both
    week = WEEK.window
    same(
        ach_checks(tables, WEEK), connection,
        statements._ach_sql(f"date '{week.start}'", f"date '{week.end}'"),
    )
    same(change_fund(tables, PARAMS), connection, statements._change_fund_sql(PARAMS.window))
    same(kiosk_reconcile(tables, PARAMS), connection, statements._kiosk_sql(PARAMS.window))


def test_till_variance(both):
    tables, connection = both
    names = "p.first_name || ' ' || p.last_name"
    full = (
        "case when p.party_id is not null then "
        "coalesce(p.first_name, '') || ' ' || coalesce(p.last_name, '') end"
    )
    sql = statements._till_sql(PARAMS.window).replace(names, full)
    same(till_variance(tables, PARAMS), connection, sql)


@pytest.mark.parametrize("safe", [False, True], ids=["treasury", "smartsafe"])
def test_treasury_branches(both, safe):
    """All branches at once, over a range of days and every store."""
    tables, connection = both
    params = ReportParams(Window(DAY, DAY))
    branches = (plan.smartsafe_branches if safe else plan.treasury_branches)(tables, params)
    merged = branches.parts["payments"].unionByName(branches.parts["over_short"])
    rows = branches.shown(merged).withColumnRenamed("deposit_ref", "ref")
    count = same(rows, connection, f"{statements._parts(params.window, safe)} select * from branch")
    assert count > 0


@pytest.mark.parametrize("safe", [False, True], ids=["treasury", "smartsafe"])
def test_treasury_backfill(both, safe):
    from tenderflow.plans.backfill import backfill

    tables, connection = both
    name = "smartsafe_treasury" if safe else "treasury"
    same(
        backfill(name, tables, WEEK), connection,
        statements._report_sql(WEEK.window, safe, statements._RUN_DATE),
    )
