"""Sinks, scheduled runs, sources and staging."""

import glob
import os
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from decimal import Decimal

import pytest
from literal import DAY, random_rows, spark_tables
from pyspark.sql import functions as F

from tenderflow.params import ReportParams, Window, ach_window, daily_window, till_window
from tenderflow.plans import bundle, registry
from tenderflow.plans.ach import ach_checks
from tenderflow.plans.shared import Shared, once
from tenderflow.plans.treasury import smartsafe_treasury
from tenderflow.schemas import TABLES
from tenderflow.sinks import (
    DAILY,
    NO_DATA,
    TEXTS,
    WEEKLY,
    empty_note,
    read_report,
    render_cells,
    replacing,
    write_report,
)
from tenderflow.sources import (
    date_predicates,
    load_tables,
    parquet_reader,
    residue_predicates,
    stage,
    staging_root,
    write_tables,
)
from tenderflow.sources.tables import SPLIT_KEYS, read_predicates


def test_windows():
    run = date(2024, 3, 1)
    assert daily_window(run) == Window.day(date(2024, 2, 28))
    assert till_window(run) == Window.day(date(2024, 2, 29))
    assert ach_window(run) == Window(date(2024, 2, 23), date(2024, 2, 29))
    with pytest.raises(ValueError):
        Window(run, date(2024, 2, 1))


def test_output_paths(spark):
    def path(name, run, period):
        return bundle.output_paths(spark, [name], run, period)[name]

    run = date(2024, 3, 1)
    assert path("kiosk", run, DAILY) == "report=kiosk/as_of=01_March_2024"
    assert path("ach", run, WEEKLY) == "report=ach/as_of=March_2024"
    assert path("ach", date(2024, 3, 29), WEEKLY) == path("ach", run, WEEKLY)


def test_cells(spark):
    df = spark.createDataFrame(
        [("a", 1, 2, Decimal("10.500000"), 1.5, True, DAY), (None,) * 7,
         ("b", 3, 4, Decimal("100.000000"), 2.0, False, DAY)],
        "s string, i int, l bigint, m decimal(17,6), d double, b boolean, t date",
    )
    cells = render_cells(df)
    assert [f.dataType.simpleString() for f in cells.schema.fields] == [
        "string", "int", "string", "string", "double", "boolean", "string",
    ]
    assert tuple(cells.collect()[0]) == ("a", 1, "2", "10.5", 1.5, True, "2024-01-03")
    assert cells.collect()[2].m == "100"


def test_empty_note(spark):
    empty = spark.createDataFrame([], "`a#` bigint, b string")
    assert [tuple(row) for row in empty_note(empty).collect()] == [(NO_DATA, None)]


def read_text(path):
    return "".join(open(part).read() for part in sorted(glob.glob(f"{path}/part-*")))


def test_empty_report_leaves_a_note_or_a_header(spark, tmp_path):
    empty = spark.createDataFrame([(1, "x")], "a bigint, b string").filter("a > 1")
    assert write_report(empty, f"{tmp_path}/note", placeholder=True) == 0
    assert read_text(f"{tmp_path}/note").strip().split(",")[0] == NO_DATA
    assert write_report(empty, f"{tmp_path}/plain") == 0
    assert read_text(f"{tmp_path}/plain").strip() in ("", "a,b")


def test_a_failing_report_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    def broken(tables, params):
        raise RuntimeError("no such column\nmore")

    tables = spark_tables(spark, random_rows(8))
    quick = {
        "till_variance": replace(registry.STATEMENTS["till_variance"], build=broken),
        "change_fund": registry.STATEMENTS["change_fund"],
        "kiosk_reconcile": registry.STATEMENTS["kiosk_reconcile"],
    }
    monkeypatch.setattr(registry, "STATEMENTS", quick)
    monkeypatch.setattr(bundle, "STATEMENTS", quick)
    status = bundle.run_bundle(spark, tables, date(2024, 1, 5), DAILY, str(tmp_path))
    rows = {row.report: row for row in status.collect()}
    assert not rows["till_variance"].ok and rows["till_variance"].message == "no such column"
    assert rows["change_fund"].ok and rows["change_fund"].row_count == 28
    assert os.path.isdir(f"{tmp_path}/{rows['kiosk_reconcile'].path}")
    listed = [row.report for row in bundle.manifest(status).collect()]
    assert listed == ["change_fund", "kiosk_reconcile"]


def test_a_second_run_replaces_the_first(spark, tmp_path):
    tables = spark_tables(spark, random_rows(8))
    for _ in range(2):
        status = bundle.run_bundle(
            spark, tables, date(2024, 1, 8), WEEKLY, str(tmp_path), fmt="parquet"
        ).first()
    assert spark.read.parquet(f"{tmp_path}/{status.path}").count() == status.row_count


def test_stored_tables_give_the_same_report(spark, tmp_path):
    tables = spark_tables(spark, random_rows(8))
    write_tables(tables, str(tmp_path))
    stored = load_tables(parquet_reader(spark, str(tmp_path)))
    week = ReportParams(Window(date(2024, 1, 1), date(2024, 1, 7)))
    assert ach_checks(stored, week).collect() == ach_checks(tables, week).collect()


def test_loading_fixes_case_and_types(spark):
    source = spark.createDataFrame([("1", "E1")], "PARTY_ID string, EMPLOYEE_ID string")
    loaded = load_tables(lambda name: source, ["hrs_employee"])["hrs_employee"]
    assert loaded.dtypes == [("party_id", "bigint"), ("employee_id", "string")]


def test_database_reads_are_split_and_whole(spark):
    parts = date_predicates(Window(date(2024, 2, 28), date(2024, 3, 1)))
    assert parts[1:4] == [
        "business_date = DATE '2024-02-28'", "business_date = DATE '2024-02-29'",
        "business_date = DATE '2024-03-01'",
    ]
    days = [(None,), (date(1999, 1, 1),), (date(2030, 1, 1),), *[
        (date(2024, month, day),) for month in (1, 2, 3) for day in range(1, 30)
    ]]
    rows = spark.createDataFrame(days, "business_date date")
    found = [row for part in parts for row in rows.filter(part).collect()]
    assert sorted(map(str, found)) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_reads_by_remainder_are_whole(spark, parts):
    keys = [(None,), (0,), *[(i,) for i in range(-30, 31)], (-(2**62),), (2**62,)]
    rows = spark.createDataFrame(keys, "k bigint")
    predicates = residue_predicates("k", parts)
    assert len(predicates) == parts + 1
    found = [row for part in predicates for row in rows.filter(part).collect()]
    assert sorted(map(str, found)) == sorted(map(str, rows.collect()))


def test_no_table_is_read_by_one_task():
    for name in TABLES:
        for window in (None, Window(DAY, DAY)):
            assert len(read_predicates(name, window, SPLIT_KEYS, 8)) >= 4
    assert read_predicates("crm_party", None, {"crm_party": "x"}, 2)[0] == "MOD(x, 2) = 0"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_failing_write_leaves_the_former_output(spark, tmp_path, fmt):
    path = f"{tmp_path}/report=x/as_of=y"
    good = spark.range(5).select(F.col("id").cast("string").alias("a"))
    assert write_report(good, path, fmt) == 5
    before = sorted(os.listdir(path))
    # the last of four tasks fails when the others are done
    half = spark.range(0, 100, 1, 4).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("x").alias("a")
    )
    with pytest.raises(Exception, match="broken"):
        write_report(half, path, fmt)
    assert sorted(os.listdir(path)) == before and os.listdir(f"{tmp_path}/report=x") == ["as_of=y"]
    assert spark.read.format(fmt).option("header", True).load(path).count() == 5
    assert write_report(good.limit(2), path, fmt) == 2
    assert spark.read.format(fmt).option("header", True).load(path).count() == 2
    assert os.listdir(f"{tmp_path}/report=x") == ["as_of=y"]


def test_an_output_that_cannot_take_its_place_leaves_the_former_one(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_report(spark.range(3).select(F.col("id").cast("string").alias("a")), path)
    with pytest.raises(OSError), replacing(spark, path):
        pass  # nothing was written beside
    assert spark.read.option("header", True).csv(path).count() == 3
    assert os.listdir(tmp_path) == ["out"]


def test_statements_of_a_bundle_run_at_the_same_time(spark, tmp_path, monkeypatch):
    """The status is that of one after another, in the same order and in less time."""
    from dataclasses import replace

    def slowly(build):
        def run(tables, params):
            time.sleep(2)
            return build(tables, params)

        return run

    slow = {
        name: replace(report, build=slowly(report.build))
        for name, report in registry.STATEMENTS.items()
    }
    monkeypatch.setattr(registry, "STATEMENTS", slow)
    tables = spark_tables(spark, random_rows(8))

    def run(at_once):
        started = time.time()
        status = bundle.run_bundle(
            spark, tables, date(2024, 1, 5), DAILY, f"{tmp_path}/{at_once}", at_once=at_once
        )
        return [tuple(row) for row in status.collect()], time.time() - started

    run(1)
    one, spent = run(1)
    all_, less = run(5)
    assert all_ == one and [row[0] for row in one] == [r.name for r in registry.statements_of(DAILY)]
    assert less < spent - 4


def test_statements_share_what_they_ask_for(spark):
    tables = Shared({"a": spark.range(3)})
    built = []

    def build():
        built.append(1)
        return tables["a"]

    assert once(tables, "x", 1, build).count() == 3
    assert once(tables, "x", 1, build).count() == 3 and len(built) == 1
    assert once(tables, "x", 2, build).count() == 3 and len(built) == 2
    with ThreadPoolExecutor(4) as threads:
        list(threads.map(lambda _: once(tables, "y", 1, build), range(8)))
    assert len(built) == 3 and dict(tables).keys() == {"a"}


def test_staging_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert staging_root(spark) == named.rstrip("/")
    assert stage(spark.range(3), "some").inputFiles()[0].split("/tenderflow-")[0].endswith(
        named.rstrip("/")
    )


def test_staging_needs_a_named_folder():
    class Bare:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(Bare())


def test_store_pattern(spark, small):
    from tenderflow.functions import asked_rows

    lines = small["ttr_tndr_lineitm"]
    day = Window.day(DAY)
    every = lines.filter(asked_rows(ReportParams(day)))
    some = lines.filter(asked_rows(ReportParams(day, store_pattern="101_")))
    stores = {row.rtl_loc_id for row in some.select("rtl_loc_id").distinct().collect()}
    assert stores and stores <= set(range(1010, 1020))
    assert some.count() == every.filter(F.col("rtl_loc_id").between(1010, 1019)).count()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_bundle_writes_each_listing_once(spark, small, tmp_path, fmt):
    """Rows name it, so an output grows with the rows and not with rows times deposits."""
    status = bundle.run_bundle(spark, small, date(2024, 1, 5), DAILY, str(tmp_path), fmt)
    row = status.filter("report = 'smartsafe_treasury'").first()
    path = f"{tmp_path}/{row.path}"
    want = render_cells(smartsafe_treasury(small, ReportParams(Window.day(DAY)))).collect()
    texts = spark.read.format(fmt).option("header", True).load(f"{path}/{TEXTS}").collect()
    listings = {one.deposits for one in want if one.deposits}
    assert listings and sorted(listings) == sorted(one.listing for one in texts)
    keyed = spark.read.format(fmt).option("header", True).load(path)
    assert keyed.columns == list(want[0].__fields__) and keyed.count() == row.row_count
    assert not listings & {one.deposits for one in keyed.collect()}
    found = read_report(spark, path, fmt).collect()
    assert sorted(tuple(map(str, one)) for one in found) == sorted(
        tuple(map(str, one)) for one in want
    )
