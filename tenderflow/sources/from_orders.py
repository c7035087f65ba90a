"""Point-of-sale tables derived from the order tables the checks are given.

Orders become sales (seven of ten) or till counts (three of ten) of 25 stores with three
workstations, over seven business dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenderflow.codes import Codes
from tenderflow.schemas import DATED_TABLES, LINE_KEY, MONEY, TABLES, TXN_KEY
from tenderflow.sources.staging import stage, staging_folder
from tenderflow.sources.tables import (
    CREATED_TABLES,
    append_rows,
    conform,
    created_of,
    derived_tables,
    load_tables,
    parquet_reader,
    write_tables,
)

#: what is stored about a table, by name
_ABOUT = {created_of(name): name for name in CREATED_TABLES} | {
    derived.name: derived.source for derived in derived_tables(Codes())
}

#: most rows of one workstation and date that are numbered in one group
BLOCK = 1 << 20


def number_within(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """row_number over ``group`` by a unique integer ``order``, without whole groups in a task.

    Rows are numbered in blocks of the order column; the counts of the blocks before are added.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    block = [*group, "_block"]
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*block)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(W.partitionBy(*block).orderBy(order))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, block)
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_before", "_inside")
    )


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


class OrderTables(Mapping[str, DataFrame]):
    """Lazy mapping; a table is derived once, stored in the staging folder and reused.

    Tables are stored as ``write_tables`` does, with what it notes and derives.  Some rows of some
    dates come afterwards, in files that nobody has noted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._stored = staging_folder(spark, "pos")
        self._ready: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            source = _ABOUT.get(name, name)
            if source not in TABLES:
                raise KeyError(name)
            self._store(source)
        return self._ready[name]

    def _store(self, name: str) -> None:
        df = conform(_DERIVE[name](self), name)
        if name in DATED_TABLES:
            # postings are numbered by store and date, and all dated tables come from their files
            later = (F.dayofmonth("business_date") % 3 == 0) & (F.col("trans_seq") % 97 == 5)
            write_tables({name: df.filter(~later)}, self._stored, grouped=True)
            append_rows(df.filter(later), self._stored, name, grouped=True)
        else:
            write_tables({name: df}, self._stored)
        self._ready |= load_tables(parquet_reader(self.spark, self._stored), [name])

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @property
    def postings(self) -> DataFrame:
        """Orders with their place in the point-of-sale world."""
        if "postings" not in self._ready:
            customer, order = F.col("o_custkey"), F.col("o_orderkey")
            placed = self.given("orders").select(
                "o_orderkey", "o_custkey", "o_orderstatus",
                (1000 + customer % 25).alias("rtl_loc_id"),
                F.date_add(F.lit("2024-01-01").cast("date"), (order % 7).cast("int"))
                .alias("business_date"),
                (1 + customer % 3).alias("wkstn_id"),
                F.col("o_totalprice").cast(MONEY).alias("amt"),
            )
            group = ["rtl_loc_id", "business_date", "wkstn_id"]
            numbered = number_within(placed, group, "o_orderkey", "trans_seq")
            late = F.when(order % 17 == 0, 1).otherwise(0)  # made after midnight
            minutes = F.make_dt_interval(days=late, mins=(order % 1440).cast("int"))
            self._ready["postings"] = stage(numbered.withColumns({
                "organization_id": F.when(customer % 29 == 0, 2).otherwise(1),
                "create_user_id": customer,
                "create_date": F.col("business_date").cast("timestamp") + minutes,
            }), "postings")
        return self._ready["postings"]

    @property
    def sales(self) -> DataFrame:
        return self.postings.filter(F.col("o_orderkey") % 10 < 7)

    @property
    def session(self) -> Column:
        return 10 * F.col("rtl_loc_id") + F.col("wkstn_id")


def _transactions(t: OrderTables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.postings.select(
        *TXN_KEY,
        F.when(F.col("o_orderkey") % 10 < 7, "RETAIL_SALE").otherwise("TENDER_CONTROL")
        .alias("trans_typcode"),
        F.when(status == "F", "COMPLETE").when(status == "O", "NEW").otherwise("SUSPEND")
        .alias("trans_statcode"),
        t.session.alias("session_id"), "create_date", "create_user_id",
    )


def _tender_lines(t: OrderTables) -> DataFrame:
    line = F.col("rtrans_lineitm_seq")
    kind = (F.col("o_orderkey") + line) % 4
    return t.sales.withColumn("rtrans_lineitm_seq", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        *LINE_KEY,
        F.when(kind == 0, "USD_CURRENCY").when(kind == 1, "ACH_CHECK").when(kind == 2, "VISA")
        .otherwise("CHECK").alias("tndr_id"),
        F.when(line == 1, F.col("amt")).otherwise((F.col("amt") / 4).cast(MONEY)).alias("amt"),
        "create_date", "create_user_id",
    )


def _lines(t: OrderTables) -> DataFrame:
    void = F.when(F.col("trans_seq") % 11 == 0, 1).otherwise(0)
    return t["ttr_tndr_lineitm"].select(*LINE_KEY, void.alias("void_flag"))


def _property(code: Column, text: Column | None = None, amount: Column | None = None) -> Column:
    return F.struct(
        code.alias("property_code"),
        (_null("string") if text is None else text).alias("string_value"),
        (_null(MONEY) if amount is None else amount.cast(MONEY)).alias("decimal_value"),
    )


def _line_properties(t: OrderTables) -> DataFrame:
    seq, first = F.col("trans_seq"), F.col("rtrans_lineitm_seq") == 1
    posted = seq % 2 == 0
    whole = F.concat_ws(
        "::", F.lit("1"), _text("rtl_loc_id"), F.lit("D"), _text("wkstn_id"), _text("trans_seq")
    )
    link = F.when(seq % 26 == 0, "1::short").otherwise(whole)
    candidates = F.array(
        F.when(posted, _property(
            F.lit("CPS_POSTED_TNDR_AMT"), amount=F.col("amt") - (seq % 3).cast(MONEY)
        )),
        *[
            F.when(posted, _property(
                F.lit(f"CPS_POSTED_TNDR_AMT_{n}"), F.lit(f"P{n}"), F.lit(10 * n)
            ))
            for n in (1, 2)
        ],
        F.when(first, _property(F.lit("SPECTRUM_BILLER_ID"), _text(F.lit(8000000000) + seq % 5))),
        F.when(first & (seq % 13 == 0), _property(F.lit("SPS_REVERSAL_ORIG_TRANS_ID"), link)),
    )
    return _exploded(t["ttr_tndr_lineitm"], LINE_KEY, candidates)


def _exploded(df: DataFrame, key: list[str], candidates: Column) -> DataFrame:
    kept = F.filter(candidates, lambda one: one.isNotNull())
    return df.select(*key, F.explode(kept).alias("p")).select(*key, "p.*")


def _sale_lines(t: OrderTables) -> DataFrame:
    # the remainder that decides on both is all that goes through the join
    kind = F.col("l_partkey") % 12
    lines = t.given("lineitem").select("l_orderkey", kind.alias("kind"), "l_linenumber")
    orders = t.postings.select("o_orderkey", *TXN_KEY)
    sold = stage(
        orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(*TXN_KEY, "l_linenumber", "kind"),
        "sold",
    )
    part = F.col("kind") % 4
    return sold.select(
        *TXN_KEY, F.col("l_linenumber").alias("rtrans_lineitm_seq"),
        F.when(part == 0, "MOBILEOTD0001").when(part == 1, "MOBILEOTS0001")
        .otherwise(F.concat(F.lit("ITEM"), _text(part))).alias("item_id"),
        F.when(part == 1, "MOBILEOTS0001").when(part == 2, "SPECTRUM001").otherwise("SCAN")
        .alias("scanned_item_id"),
        F.when(F.col("kind") % 3 == 0, "NP").otherwise("ACC").alias("merch_level_1"),
    )


def _sessions(t: OrderTables) -> DataFrame:
    return t["trn_trans"].select("organization_id", "rtl_loc_id", "session_id").distinct()


def _session_workstations(t: OrderTables) -> DataFrame:
    columns = ["organization_id", "rtl_loc_id", "session_id", "wkstn_id"]
    return t["trn_trans"].select(*columns).distinct()


def _controls(t: OrderTables) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    turn = customer % 13
    # one sale in seven leaves a bag under its own sequence
    return t.postings.filter(order % 10 >= 6).select(
        *TXN_KEY,
        F.when((order % 3 == 0) & (customer % 9 == 0), "EndCount")
        .when(order % 3 == 0, "ENDCOUNT").when(order % 3 == 1, "SAFE_BAG_ADJUST")
        .otherwise("BANK_DEPOSIT").alias("typcode"),
        F.when(turn < 3, _null("string")).when(turn < 6, "STOREBANK").when(turn < 9, "TILL1")
        .otherwise("KIOSK").alias("outbound_tndr_repository_id"),
        F.when(customer % 5 == 0, "SAFE").otherwise("CHANGEFUND")
        .alias("inbound_tndr_repository_id"),
        t.session.alias("outbound_session_id"), (t.session + 1).alias("inbound_session_id"),
        "amt", F.when(customer % 7 == 0, "MISCOUNT").alias("reascode"),
        F.when(order % 4 == 0, F.concat(F.lit("BAG"), _text(order % 100))).alias("safe_bag_id"),
        "create_date", "create_user_id",
    )


def _counts(t: OrderTables) -> DataFrame:
    seq = F.col("trans_seq")
    second = F.col("second")
    seconds = F.when(seq % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t["tsn_tndr_control_trans"].withColumn("second", F.explode(seconds)).select(
        *TXN_KEY, F.when(second == 0, "USD_CURRENCY").otherwise("CHECK").alias("tndr_id"),
        F.when(second == 0, "CURRENCY").otherwise("CHECK").alias("tndr_typcode"),
        "amt", F.col("amt").alias("deposit_amt"), (seq % 5 - 2).alias("difference_amt"),
        ((seq + second) % 2).alias("media_count"), "create_user_id",
    )


def _transaction_properties(t: OrderTables) -> DataFrame:
    seq = F.col("trans_seq")
    candidates = F.array(
        *[
            _property(
                F.lit(f"SMARTSAFE_DEPOSIT_ID_{n}"), F.concat(F.lit("D"), _text(seq % 9 + n))
            )
            for n in (1, 2)
        ],
        _property(
            F.lit("SMARTSAFE_DEPOSIT_AMT_1"),
            F.when(seq % 2 == 0, "Kiosk").otherwise("Till"), F.col("amt") - 1,
        ),
        _property(F.lit("CHA_SMARTSAFE_BATCH_NUM_1"), F.concat(F.lit("B"), _text(seq % 4))),
    )
    return _exploded(t["tsn_tndr_control_trans"], TXN_KEY, candidates)


def _notes(t: OrderTables) -> DataFrame:
    seq = F.col("trans_seq")
    noted = t["tsn_tndr_control_trans"].filter(seq % 2 == 0)
    return noted.select(*TXN_KEY, F.concat(F.lit("note "), _text(seq % 6)).alias("note"))


def _people(t: OrderTables) -> DataFrame:
    key = F.col("c_custkey")
    return t.given("customer").select(
        key.alias("party_id"), F.concat(F.lit("E"), _text(key)).alias("employee_id"),
        F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"),
    )


def _stores(t: OrderTables) -> DataFrame:
    nation = t.given("nation").join(
        t.given("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key, name = F.col("n_nationkey"), F.col("n_name")
    return nation.select(
        F.lit(1).alias("organization_id"), (1000 + key).alias("rtl_loc_id"),
        name.alias("store_name"), F.concat(F.lit("ADDR "), name).alias("address1"),
        F.col("r_name").alias("state"), F.concat(F.lit("CITY "), name).alias("city"),
        F.col("r_name").alias("district"), _text(10000 + key).alias("postal_code"),
    )


def _tenders(t: OrderTables) -> DataFrame:
    rows = [
        (1, "USD_CURRENCY", "CURRENCY"), (1, "ACH_CHECK", "CHECK"),
        (1, "VISA", "CREDIT_CARD"), (1, "CHECK", "CHECK"),
    ]
    return t.spark.createDataFrame(rows, "organization_id int, tndr_id string, tndr_typcode string")


def _store_scope() -> Column:
    return F.concat(F.lit("STORE:"), _text(1000 + F.col("n_nationkey")))


def _config_changes(t: OrderTables) -> DataFrame:
    enabled = F.col("n_regionkey").isin(0, 1)
    fixed = [
        F.lit("SYSCFG").alias("change_type"), F.lit("SystemConfig.xml").alias("change_subtype")
    ]
    stores = t.given("nation").select(
        F.lit(1).alias("organization_id"), F.lit("STORE").alias("profile_group_id"),
        _text("n_regionkey").alias("profile_element_id"), *fixed,
        F.col("n_nationkey").alias("config_version"),
        F.when(enabled, "x SmartSafeEnabled=true y").otherwise("SmartSafeEnabled=false")
        .alias("changes"),
    )
    # sites beside the stores, with repeated and tied versions
    key, version = F.col("s_suppkey"), F.col("version")
    on = F.when((key + version) % 3 == 0, "SmartSafeEnabled=true").otherwise(
        "SmartSafeEnabled=false"
    )
    pushes = F.array(*[
        F.struct(F.lit(n).alias("version"), F.lit(tie).alias("tie"))
        for n, tie in ((1, False), (2, False), (2, False), (2, True))
    ])
    pushed = t.given("supplier").select("s_suppkey", F.inline(pushes)).filter(
        ~F.col("tie") | (key % 4 == 0)
    )
    sites = pushed.select(
        F.lit(1).alias("organization_id"), F.lit("SITE").alias("profile_group_id"),
        _site().alias("profile_element_id"), *fixed, version.cast("bigint").alias("config_version"),
        F.when(F.col("tie"), "a tie: SmartSafeEnabled=true").otherwise(on).alias("changes"),
    )
    return stores.unionByName(sites)


def _site() -> Column:
    return F.concat(F.lit("S"), _text("s_suppkey"))


def _deployments(t: OrderTables) -> DataFrame:
    failed = F.col("n_nationkey") % 6 == 5
    kind = F.lit("CONFIGURATOR").alias("deployment_type")
    stores = t.given("nation").select(
        F.col("n_nationkey").cast("bigint").alias("config_version"),
        _text("n_regionkey").alias("profile_element_id"),
        F.lit("STORE").alias("profile_group_id"), kind,
        F.when(failed, "FAILED").otherwise("COMPLETE").alias("deploy_status"),
        F.when(F.col("n_regionkey") == 0, F.lit("WEST")).otherwise(_store_scope())
        .alias("org_scope"),
    )
    key, version = F.col("s_suppkey"), F.col("config_version")
    versions = F.explode(F.expr("array(1L, 2L)")).alias("config_version")
    sites = t.given("supplier").select("s_suppkey", versions).select(
        version, _site().alias("profile_element_id"), F.lit("SITE").alias("profile_group_id"),
        kind,
        F.when((version == 2) & (key % 5 == 0), "FAILED").otherwise("SCHEDULED")
        .alias("deploy_status"),
        F.concat(F.lit("STORE:"), _text(100000 + key)).alias("org_scope"),
    )
    return stores.unionByName(sites)


def _collections(t: OrderTables) -> DataFrame:
    members = t.given("nation").filter(F.col("n_nationkey") % 5 == 0)
    return members.select(
        F.lit("WEST").alias("collection_name"), _store_scope().alias("org_scope_code")
    )


_DERIVE: dict[str, Callable[[OrderTables], DataFrame]] = {
    "ttr_tndr_lineitm": _tender_lines,
    "tnd_tndr": _tenders,
    "trl_rtrans_lineitm": _lines,
    "trl_rtrans_lineitm_p": _line_properties,
    "trl_sale_lineitm": _sale_lines,
    "trn_trans": _transactions,
    "trn_trans_p": _transaction_properties,
    "trn_trans_notes": _notes,
    "tsn_session": _sessions,
    "tsn_session_wkstn": _session_workstations,
    "tsn_tndr_control_trans": _controls,
    "tsn_tndr_tndr_count": _counts,
    "loc_rtl_loc": _stores,
    "crm_party": _people,
    "hrs_employee": lambda t: t["crm_party"].select("party_id", "employee_id"),
    "cfg_profile_element_changes": _config_changes,
    "dpl_deployment": _deployments,
    "loc_rtl_loc_collection_element": _collections,
}

_open: dict[tuple[str, str], OrderTables] = {}


def order_tables(spark: SparkSession, root: str) -> OrderTables:
    """The tables of one data folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, root.rstrip("/"))
    if key not in _open:
        _open[key] = OrderTables(spark, root.rstrip("/"))
    return _open[key]
