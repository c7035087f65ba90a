"""Shape of the plans, and properties that hold for whole statements."""

import glob
import os
import re
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from literal import DAY
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tenderflow.params import ReportParams, Window
from tenderflow.plans import bundle, shared, tenders
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.backfill import backfill
from tenderflow.plans.change_fund import change_fund
from tenderflow.plans.kiosk import kiosk_reconcile
from tenderflow.plans.tenders import posted_elsewhere
from tenderflow.plans.till_variance import till_variance
from tenderflow.plans.treasury import (
    ORDER,
    smartsafe_branches,
    smartsafe_rows,
    smartsafe_treasury,
    treasury,
)
from tenderflow.schemas import DATED_TABLES, TABLES
from tenderflow.sinks import write_report
from tenderflow.sources import (
    append_rows,
    coverage,
    load_tables,
    parquet_reader,
    refresh,
    stage,
    write_tables,
)
from tenderflow.sources.from_orders import OrderTables
from tenderflow.sources.tables import CREATED_TABLES, created_of

PARAMS = ReportParams(Window.day(DAY))
WEEK = ReportParams(Window(date(2024, 1, 1), date(2024, 1, 7)))
STATEMENTS = {
    "ach": ach_checks, "change_fund": change_fund, "kiosk": kiosk_reconcile,
    "till": till_variance, "treasury": treasury, "smartsafe": smartsafe_treasury,
}


def plan_text(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def unhinted(spark):
    """As for tables that are too large for Spark to broadcast on its own."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_no_pairwise_joins_and_nothing_is_broadcast_unchecked(spark, small, unhinted, name, capsys):
    text = plan_text(STATEMENTS[name](small, PARAMS), capsys)
    assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text
    assert "BroadcastHashJoin" not in text


def test_filters_reach_the_scan(small, capsys):
    text = plan_text(ach_checks(small, WEEK), capsys)
    scan = next(block for block in text.split("\n\n") if "PartitionFilters: [isnotnull(bus" in block)
    assert "EqualTo(tndr_id,ACH_CHECK)" in scan
    assert "create_user_id" not in scan
    text = plan_text(till_variance(small, PARAMS), capsys)
    assert "EqualTo(tndr_id,USD_CURRENCY)" in text
    assert text.count("PartitionFilters: [isnotnull(business_date") >= 3


def spoil(root, names):
    """Make the files of dates unreadable that have no rows of the day; some of the day before
    are created after midnight."""
    kept = {f"business_date={DAY}", f"business_date={DAY - timedelta(days=1)}"}
    for name in names:
        for path in glob.glob(f"{root}/{name}/business_date=*/part-*"):
            if not any(date_ in path for date_ in kept):
                os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
                size = os.path.getsize(path)
                with open(path, "wb") as file:
                    file.write(b"x" * size)  # the file as noted, by its name and size


def test_a_day_does_not_read_other_dates(spark, small, tmp_path):
    """Not even of the tables that match on any date: their derived tables stand for them."""
    root = str(tmp_path)
    write_tables(small, root)
    asked = ReportParams(Window.day(DAY))
    statements = {name: report for name, report in STATEMENTS.items() if name != "ach"}
    want = {name: report(small, asked).count() for name, report in statements.items()}
    spoil(root, DATED_TABLES)
    spoiled = load_tables(parquet_reader(spark, root))
    with pytest.raises(Exception):
        spoiled["trl_sale_lineitm"].agg(F.max("item_id")).collect()
    for name, report in statements.items():
        assert report(spoiled, asked).count() == want[name]


def sorted_rows(df):
    return sorted(map(str, df.collect()))


LATER = f"(business_date = date '{DAY}' or trans_seq % 3 = 0)"


@pytest.fixture(scope="module")
def grown(spark, small, tmp_path_factory):
    """Tables with a new date and late rows of old dates, which came after all was noted."""
    root = str(tmp_path_factory.mktemp("grown"))
    dated = [name for name in small if name in DATED_TABLES]
    write_tables(
        {name: small[name].filter(f"not {LATER}") if name in dated else small[name] for name in small}, root
    )
    for name in dated:
        append_rows(small[name].filter(LATER), root, name)
    return root


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_files_that_nobody_noted_are_read(spark, small, grown, name):
    whole = {one: small[one] for one in TABLES}  # without ranges and derived tables
    stored = load_tables(parquet_reader(spark, grown))
    assert len(stored) == len(TABLES) + len(CREATED_TABLES) + 2
    for asked in (PARAMS, WEEK):
        found = sorted_rows(STATEMENTS[name](stored, asked))
        assert found == sorted_rows(STATEMENTS[name](whole, asked))
    assert found


def test_refreshed_notes_cover_all_files(spark, small, grown, tmp_path):
    def changed(root, derived):
        now = coverage.current_files(spark, f"{root}/{derived.source}")
        noted = spark.read.schema(coverage.NOTED).parquet(f"{root}/{derived.name}/files")
        return len(coverage.changed_dates(now, noted))

    index = coverage.posted_index(PARAMS.codes)
    assert changed(grown, index) == changed(grown, coverage.MEDIA) == 7
    root = str(tmp_path)
    for derived in (index, coverage.MEDIA):
        name = derived.source
        write_tables({name: small[name].filter(f"not {LATER}")}, root)
        some = small[name].filter(LATER).filter(F.dayofmonth("business_date") == 5)
        append_rows(some, root, name)
        assert changed(root, derived) == 1  # only the date whose files are other ones
        stored = load_tables(parquet_reader(spark, root), [name])
        want = sorted_rows(derived.build(small[name].filter(f"not {LATER}").unionByName(some)))
        assert sorted_rows(stored[derived.name]) == want
        refresh(spark, root, name)
        assert changed(root, derived) == 0
        stored = load_tables(parquet_reader(spark, root), [name])
        assert sorted_rows(stored[derived.name]) == want


def test_tables_are_derived_without_another_exchange(spark, monkeypatch):
    """Postings lie by store and date already; lines and postings meet once."""
    plans = {}
    write = DataFrameWriter.parquet

    def noted(self, path, *rest, **options):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        plans.setdefault(os.path.basename(path), []).append(plan)
        return write(self, path, *rest, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    derived = OrderTables(spark, SMALL)
    for name in DATED_TABLES:
        assert derived[name].first()
        assert len(plans[name]) == 2 and not any("Exchange" in plan for plan in plans[name])
    every = [plan for found in plans.values() for plan in found]
    assert sum("l_linenumber" in plan and "Join" in plan for plan in every) == 1


def test_files_of_one_task_have_the_times_of_their_own_dates(spark):
    """They have one name, and may have one size."""
    days = [date(2024, 1, 1), date(2024, 1, 2)]
    current = spark.createDataFrame(
        [(day, "part-0", 9) for day in days], "business_date date, file string, size bigint"
    )
    times = current.select("*", *[F.col("business_date").cast("timestamp").alias(c) for c in ("first", "last")])
    found = coverage.created_ranges(current, times)
    assert sorted_rows(found) == sorted_rows(times.select("business_date", "first", "last"))


def test_a_replaced_or_missing_file_changes_its_date(spark, small, tmp_path):
    name = coverage.MEDIA.source
    write_tables({name: small[name]}, str(tmp_path))
    gone = sorted(glob.glob(f"{tmp_path}/{name}/business_date={DAY}/part-*"))
    for path in gone:
        os.remove(path)
    stored = load_tables(parquet_reader(spark, str(tmp_path)), [name])
    left = small[name].filter(F.col("business_date") != F.lit(DAY))
    assert sorted_rows(stored[coverage.MEDIA.name]) == sorted_rows(coverage.MEDIA.build(left))


def test_rows_without_a_date_are_always_read(spark, small, tmp_path):
    name = coverage.MEDIA.source
    undated = small[name].limit(20).withColumns({
        "business_date": F.lit(None).cast("date"), "media_count": F.lit(1).cast("bigint"),
    })
    write_tables({name: small[name].unionByName(undated)}, str(tmp_path))
    append_rows(undated, str(tmp_path), name)
    stored = load_tables(parquet_reader(spark, str(tmp_path)), [name])
    whole = small[name].unionByName(undated).unionByName(undated)
    assert sorted_rows(stored[coverage.MEDIA.name]) == sorted_rows(coverage.MEDIA.build(whole))


def scans(text):
    """The tables a plan scans, by folder; without Spark's pruning look-ups, which reuse a
    broadcast but show as scans."""
    return re.findall(r"Location: [^\n]*?tenderflow-\w+/(?:pos/)?([\w-]+)", text)


def test_all_line_properties_and_counts_are_only_read_by_date(spark, small, capsys):
    """What matches on any date comes from derived tables, without an exchange above the index."""
    for report in (treasury, smartsafe_treasury):
        text = plan_text(report(small, PARAMS), capsys)
        for block in text.split("\n\n"):
            if re.search(r"/(trl_rtrans_lineitm_p|tsn_tndr_tndr_count)[\],]", block):
                assert re.search(r"PartitionFilters: \[.*business_date#\d+ (IN|=) ?|isnull\(business_date", block)
    lines = small["ttr_tndr_lineitm"].filter("trans_seq = 1")
    tree = plan_text(posted_elsewhere(small, PARAMS, lines), capsys)
    index = tree.index("posted-") and re.search(r"\((\d+)\) Scan parquet spark_catalog[^\n]*", tree)
    assert index
    shape = tree[:tree.index("\n\n\n")]
    above, depth = [], None
    for line in reversed(shape[:shape.index(f"({index[1]})")].split("\n")):
        level = len(re.match(r"[\s:|+-]*", line)[0])
        if depth is None or level < depth:
            above.append(line)
            depth = level
        if "Join" in line and "LeftSemi" in line:
            break
    assert above and not any("Exchange" in line for line in above)


def test_rows_made_a_year_late_are_found(spark, small, tmp_path):
    late = {
        name: small[name].withColumn(
            "create_date",
            F.when(F.col("trans_seq") % 3 == 0, F.expr("create_date + interval 1 year"))
            .otherwise(F.col("create_date")),
        ) if name in CREATED_TABLES else small[name]
        for name in small
    }
    write_tables(late, str(tmp_path))
    stored = load_tables(parquet_reader(spark, str(tmp_path)))
    assert {created_of(name) for name in CREATED_TABLES} <= set(stored)
    for asked in (ReportParams(Window.day(date(2025, 1, 2))), PARAMS):
        for report in (change_fund, treasury):
            found = sorted(map(str, report(stored, asked).collect()))
            assert found == sorted(map(str, report(late, asked).collect()))
        assert found


@pytest.mark.parametrize("name", ["treasury", "smartsafe_treasury"])
def test_treasury_of_a_day_is_its_part_of_the_range(small, name):
    daily = sorted(map(str, STATEMENTS[name.replace("_treasury", "")](small, PARAMS).collect()))
    filled = backfill(name, small, WEEK).filter(F.col("report_date") == F.lit(DAY))
    assert sorted(map(str, filled.drop("report_date").collect())) == daily


def test_a_run_scans_tables_once_or_twice_and_no_listing_is_a_key(
    spark, small, monkeypatch, capsys, tmp_path
):
    """All that a daily bundle writes, staged sub-plans and statements."""
    texts = []
    pruning = "spark.sql.optimizer.dynamicPartitionPruning.enabled"
    spark.conf.set(pruning, "false")

    def staged(df, name):
        texts.append(plan_text(df, capsys))
        return stage(df, name)

    def written(df, *rest):
        texts.append(plan_text(df, capsys))
        return write_report(df, *rest)

    monkeypatch.setattr(shared, "stage", staged)
    monkeypatch.setattr(bundle, "write_report", written)
    try:
        status = bundle.run_bundle(
            spark, small, date(2024, 1, 5), "daily", str(tmp_path), at_once=1
        ).collect()
    finally:
        spark.conf.unset(pruning)
    assert all(row.ok for row in status)
    whole = "\n\n".join(texts)
    places = scans(whole)
    assert places.count("ttr_tndr_lineitm") == 2  # its dates, and what has no date
    assert places.count("cfg_profile_element_changes") == 1
    assert places.count("trl_sale_lineitm") == 1
    blocks = whole.split("\n\n")
    aggregates = [block for block in blocks if "Keys [" in block]
    assert aggregates and not any(
        re.search(r"Keys \[\d+\]: \[[^]]*(listing#|deposits#)", block) for block in aggregates
    )


def test_rows_get_their_texts_where_they_lie_in_order(small, unhinted, capsys):
    """A listing is as long as a day has deposits, so no row is exchanged or sorted with it."""
    ordered = smartsafe_treasury(small, PARAMS)
    above = plan_text(ordered, capsys).split("Exchange")[0]
    assert "Window" in above and above.count("Sort") == 1
    rows = ordered.collect()
    assert sorted(map(str, rows)) == sorted_rows(smartsafe_rows(small, PARAMS))
    places = [(row.locationid, row.department) for row in rows]
    assert places == sorted(places) and any(row.deposits for row in rows)


def test_rows_with_one_text_lie_together(small, unhinted, capsys):
    """So that files hold the text once; a join by key left them mixed where it was broadcast."""
    branches = smartsafe_branches(small, PARAMS)
    shown = branches.shown(branches.parts["payments"].filter("department = 'CORE'"))
    above = plan_text(shown, capsys).split("Exchange")[0]
    assert "Window" in above and "Join" not in above
    texts = [row.deposit_ref for row in shown.collect() if row.deposit_ref]
    changes = sum(one != other for one, other in zip(texts, texts[1:], strict=False))
    assert texts and changes < len(set(texts)) + small["loc_rtl_loc"].count()


def listed_rows(spark, stores, rows, listing):
    """Rows of stores and two departments, a third of them without a listing, and the texts."""
    known = spark.createDataFrame(
        [(store, f"{store}-{n}", listing(store, n)) for store in range(stores) for n in range(3)],
        "locationid bigint, listing_key string, listing string",
    )
    named = F.concat_ws("-", F.col("id") % stores, F.col("n") % 4)
    asked = spark.range(stores * rows).withColumn("n", F.floor(F.col("id") / stores)).select(
        (F.col("id") % stores).alias("locationid"),
        F.when(F.col("n") % 2 == 0, "A").otherwise("B").alias("department"),
        F.when(F.col("n") % 4 != 3, named).alias("deposit_ref"), F.col("id").alias("line"),
    )
    return asked, {("A", "B"): known}


def by_task(df):
    placed = df.withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for row in placed:
        tasks.setdefault(row.task, []).append(row)
    return placed, tasks


def test_long_texts_and_rows_without_one_are_in_different_tasks(spark, unhinted):
    """A writer that saw rows without a text holds as many with one; it takes few texts once."""
    def listing(store, n):
        long = (n + 1) * 90_000 if store % 3 else 30 + n
        return f"{store}-{n}:".ljust(long, "x")

    asked, texts = listed_rows(spark, 5, 40, listing)
    placed, tasks = by_task(tenders.ordered_with_listings(asked, ORDER, texts))
    want = {row.line: row.deposit_ref for row in asked.collect()}
    assert {row.line: (row.deposit_ref or "").split(":")[0] or None for row in placed} == want
    assert len(placed) == len(want)
    for rows in tasks.values():
        lengths = {len(row.deposit_ref or "") for row in rows}
        assert max(lengths) <= tenders.LONG_TEXT or min(lengths) > tenders.LONG_TEXT
        assert sum(lengths) <= 2 * tenders.TASK_TEXT
    order = [(row.locationid, row.department) for row in placed]
    assert order == sorted(order) and len(tasks) < 5 * 2 * 4


def test_rows_of_one_listing_go_on_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tenders, "COPIED", 10)
    asked, texts = listed_rows(spark, 2, 4_000, lambda store, n: f"{n}".ljust(20_000, "x"))
    placed, tasks = by_task(tenders.ordered_with_listings(asked, ORDER, texts))
    assert len(placed) == 8_000 and sum(row.deposit_ref is None for row in placed) == 2_000
    listed = [rows for rows in tasks.values() if rows[0].deposit_ref]
    assert max(map(len, listed)) < 500
    assert all(len({(row.department, row.deposit_ref) for row in rows}) == 1 for rows in listed)
    order = [(row.locationid, row.department) for row in placed]
    assert order == sorted(order)


def test_a_listing_beyond_a_task_shares_none(spark):
    """Else it and the next ones are more than a file stores once."""
    def listing(store, n):
        return f"{store}-{n}:".ljust(1_050_000 if n == 0 else 160_000, "x")

    asked, texts = listed_rows(spark, 2, 40, listing)
    placed, tasks = by_task(tenders.ordered_with_listings(asked, ORDER, texts))
    assert len(placed) == 80 and sum(row.deposit_ref is None for row in placed) == 20
    for rows in tasks.values():
        found = {row.deposit_ref for row in rows}
        assert len(found) == 1 or sum(map(len, found)) <= 2 * tenders.TASK_TEXT
    order = [(row.locationid, row.department) for row in placed]
    assert order == sorted(order)


def test_a_backfill_keeps_long_listings_of_all_days_apart(small, monkeypatch):
    want = sorted(str(tuple(row)) for row in backfill("smartsafe_treasury", small, WEEK).collect())
    monkeypatch.setattr(tenders, "LONG_TEXT", 12)
    monkeypatch.setattr(tenders, "TASK_TEXT", 100)
    placed, tasks = by_task(backfill("smartsafe_treasury", small, WEEK))
    assert sorted(str(tuple(row)[:-1]) for row in placed) == want
    order = [(row.locationid, row.department) for row in placed]
    assert order == sorted(order) and len({row.report_date for row in placed}) == 7
    for rows in tasks.values():
        lengths = [len(row.deposits or "") for row in rows]
        assert max(lengths) <= 12 or min(lengths) > 12
        assert len({row.deposits for row in rows}) == 1 or max(lengths) <= 100


def test_no_rows_with_listings(spark):
    asked, texts = listed_rows(spark, 1, 4, lambda store, n: "x")
    assert tenders.ordered_with_listings(asked.limit(0), ORDER, texts).count() == 0


def test_a_long_text_is_stored_once_in_a_file(spark, tmp_path):
    asked, texts = listed_rows(spark, 8, 400, lambda store, n: f"{store}{n}".ljust(100_000, "x"))
    tenders.ordered_with_listings(asked, ORDER, texts).write.parquet(f"{tmp_path}/out")
    held = 0
    for path in glob.glob(f"{tmp_path}/out/*.parquet"):
        found = pq.ParquetFile(path).metadata
        column = found.schema.to_arrow_schema().get_field_index("deposit_ref")
        held += sum(found.row_group(n).column(column).total_uncompressed_size
                    for n in range(found.num_row_groups))
    assert held < 5 * 8 * 3 * 100_000


def test_rows_repeated_for_bags_are_not_exchanged(small, unhinted, capsys):
    """Nor joined: users are looked up before, and equal rows lie in one task."""
    text = plan_text(backfill("treasury", small, WEEK), capsys)
    above = text.split("Generate")[0]
    assert above.count("HashAggregate") == 4 and "Union" in above
    assert "Exchange" not in above and "Join" not in above


def test_a_session_may_have_more_bags_than_a_list(spark):
    bags = 2 * tenders.LISTED_BAGS + 50
    controls = spark.range(bags).selectExpr(
        "1 organization_id", "7L rtl_loc_id", f"date '{DAY}' business_date", "id trans_seq",
        "concat('B', id) safe_bag_id", "70L outbound_session_id",
    )
    workstations = spark.sql("select 1 organization_id, 7L rtl_loc_id, 70L session_id, 3L wkstn_id")
    tables = {"tsn_tndr_control_trans": controls, "tsn_session_wkstn": workstations}
    payments = spark.createDataFrame(
        [(70, True, "cash"), (70, False, "card"), (71, True, "no bag")],
        "session_id bigint, is_deposit boolean, payment_type string",
    ).selectExpr(
        "*", "7L rtl_loc_id", f"date '{DAY}' business_date", "3L wkstn_id", "'session' bag_scope",
        "0L bag_seq", "cast(2 as decimal(38,6)) amount", "'d' trans_date", "'CORE' department",
        "'b' billerid", "1L create_user_id",
    )
    rows = tenders.bag_references(tables, [DAY])(payments).collect()
    found = sorted((row.payment_type, row.deposit_ref, int(row.amount)) for row in rows
                   if row.deposit_ref)
    assert found == sorted(("cash", f"B{n}", 2) for n in range(bags))
    rest = {(row.payment_type, int(row.amount)) for row in rows if not row.deposit_ref}
    assert len(rows) == bags + 2 and rest == {("card", 2 * bags), ("no bag", 2)}


def test_statements_split_the_stores(small):
    plain = {row.locationid for row in treasury(small, PARAMS).collect()}
    safe = {row.locationid for row in smartsafe_treasury(small, PARAMS).collect()}
    assert plain and safe and not plain & safe


@pytest.mark.parametrize("name", ["change_fund", "kiosk_reconcile", "till_variance"])
def test_backfill_of_a_day_is_the_daily_report(small, name):
    report = {"change_fund": change_fund, "kiosk_reconcile": kiosk_reconcile,
              "till_variance": till_variance}[name]
    daily = sorted(map(str, report(small, PARAMS).collect()))
    filled = backfill(name, small, WEEK).filter(F.col("report_date") == F.lit(DAY))
    assert sorted(map(str, filled.drop("report_date").collect())) == daily


def test_weekly_backfill_adds_up_to_the_window(small):
    runs = ReportParams(Window(date(2024, 1, 8), date(2024, 1, 8)))
    filled = backfill("ach_checks", small, runs)
    total = ach_checks(small, WEEK).agg(F.sum("sum")).first()[0]
    assert filled.agg(F.sum("sum")).first()[0] == total
    assert {row.report_date for row in filled.select("report_date").distinct().collect()} == {
        date(2024, 1, 8)
    }
