"""Tender payments by department: what was posted to billers, and what accessories took.

Every fan-out of the report (biller lines, bags of a session, transactions that share a
sequence) is a multiplication of a sum.  So amounts are added up before each of them and
multiplied by a count, and rows are only repeated where a bag id is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenderflow.functions import (
    code_like,
    day_text,
    deposit_only,
    first8,
    is_accessory_sale,
    is_core_sale,
    is_deposit,
    is_device_sale,
    is_service_sale,
    payment_type,
    posts_amount,
)
from tenderflow.operators import (
    asked,
    on_dates,
    ordered_listing,
    original_transactions,
    surplus_over,
)
from tenderflow.params import ReportParams
from tenderflow.plans.shared import Tables, once
from tenderflow.schemas import LINE_KEY, STORE_TXN_KEY, TOTAL, TXN_KEY
from tenderflow.sources.coverage import SEQUENCE_LINE, posted_index
from tenderflow.sources.staging import stage

#: how a bag relates to a payment: to its whole session, or to its very transaction
SESSION, TRANSACTION = "session", "transaction"
BAG_KEY = ["rtl_loc_id", "business_date", "wkstn_id", "session_id", "bag_scope", "bag_seq"]

#: what a payment row carries until its deposit reference is attached
LABELS = ["trans_date", "payment_type", "is_deposit", "create_user_id"]

#: what a row of a statement shows of its payments, beside the amount and the reference
SHOWN = ["rtl_loc_id", "trans_date", "department", "billerid", "payment_type", "create_user_id"]

#: most bags in one list
LISTED_BAGS = 100

#: a task's rows with listings: bytes of different texts, two such lots at most in one file (half
#: of what a Parquet file stores once), and what a row and a byte copied to it count for
TASK_TEXT, ROW_WEIGHT, COPIED = 500_000, 2, 16_384

#: bytes from which a text is not in one task with rows that have none
LONG_TEXT = 8_192

#: adds ``deposit_ref`` to payment rows and multiplies ``amount`` where that hides several
Attach = Callable[[DataFrame], DataFrame]


def asked_lines(tables: Tables, params: ReportParams) -> DataFrame:
    lines = asked(tables, "ttr_tndr_lineitm", params)
    return lines.select(
        *LINE_KEY, "tndr_id", "amt", "create_user_id",
        day_text(F.col("create_date")).alias("trans_date"),
    )


def live_lines(tables: Tables, dates: list[date]) -> DataFrame:
    """Keys of transaction lines that were not voided."""
    lines = on_dates(tables["trl_rtrans_lineitm"], dates)
    return lines.filter(F.col("void_flag") == 0).select(*LINE_KEY)


def typed_lines(
    tables: Tables, params: ReportParams, lines: DataFrame, dates: list[date]
) -> DataFrame:
    """Live tender lines with their payment type.  Tenders match by id alone."""
    kind, tender = F.col("tndr_typcode"), F.col("tndr_id")
    tenders = tables["tnd_tndr"].select(
        "tndr_id",
        payment_type(kind, tender, params.codes).alias("payment_type"),
        is_deposit(kind, tender, params.codes).alias("is_deposit"),
    )
    return lines.join(tenders, "tndr_id").join(live_lines(tables, dates), LINE_KEY)


#: bits of ``sale_traits``
CORE, DEVICE, SERVICE, ACCESSORY = 1, 2, 4, 8


def has_trait(trait: int) -> Column:
    return F.col("traits").bitwiseAND(trait) != 0


def sale_traits(tables: Tables, params: ReportParams, dates: list[date]) -> DataFrame:
    """Which departments a transaction's sale lines belong to, as bits of one number.

    One column for all of them keeps the aggregate the same wherever it is used, so that
    Spark computes and shuffles it once per report.
    """
    return once(tables, "traits", params, lambda: _traits(tables, params, dates))


def _traits(tables: Tables, params: ReportParams, dates: list[date]) -> DataFrame:
    codes = params.codes
    item, scanned = F.col("item_id"), F.col("scanned_item_id")
    bits = {
        CORE: is_core_sale(item, codes),
        DEVICE: is_device_sale(item, scanned, codes),
        SERVICE: is_service_sale(scanned, codes),
        ACCESSORY: is_accessory_sale(F.col("merch_level_1"), codes),
    }
    line = [F.when(holds, F.lit(bit)).otherwise(F.lit(0)) for bit, holds in bits.items()]
    return (
        on_dates(tables["trl_sale_lineitm"], dates)
        .groupBy(*TXN_KEY)
        .agg(F.bit_or(sum(line[1:], line[0])).alias("traits"))
    )


def biller_counts(tables: Tables, params: ReportParams, dates: list[date]) -> DataFrame:
    """Per transaction and shortened biller id: how many biller lines each department has.

    A biller line is one (id, line) of a store's transaction, whatever its organization.
    """
    billers = (
        on_dates(tables["trl_rtrans_lineitm_p"], dates)
        .filter(F.col("property_code") == params.codes.biller)
        .select(*LINE_KEY, F.col("string_value").alias("billerid"))
        .join(live_lines(tables, dates), LINE_KEY, "left_semi")
        .join(sale_traits(tables, params, dates), TXN_KEY)
    )
    lines = billers.groupBy(*STORE_TXN_KEY, "rtrans_lineitm_seq", "billerid").agg(
        F.bit_or("traits").alias("traits")
    )
    return lines.groupBy(*STORE_TXN_KEY, first8(F.col("billerid")).alias("billerid")).agg(
        F.count_if(has_trait(CORE)).alias("n_core"),
        F.count_if(has_trait(DEVICE)).alias("n_device"),
        F.count_if(has_trait(SERVICE)).alias("n_service"),
    )


def posted_amounts(
    tables: Tables, params: ReportParams, lines: DataFrame, dates: list[date]
) -> DataFrame:
    """Posted amounts of tender lines per transaction, session and posted text.

    Amounts of a transaction that a reversal names count as zero.
    """
    codes = params.codes
    properties = on_dates(tables["trl_rtrans_lineitm_p"], dates)
    posted = properties.filter(code_like(F.col("property_code"), codes.posted_amount)).select(
        *LINE_KEY, "property_code", F.col("string_value").alias("posted_text"), "decimal_value"
    )
    reversed_ones = original_transactions(properties, codes).withColumn("reversed", F.lit(True))
    sessions = on_dates(tables["trn_trans"], dates).select(*TXN_KEY, "session_id")
    amount = F.when(F.col("reversed"), F.lit(0).cast("decimal(17,6)")).otherwise(
        F.col("decimal_value")
    )
    return (
        lines.join(posted, LINE_KEY)
        .filter(posts_amount(F.col("property_code"), F.col("tndr_id"), codes))
        .join(reversed_ones, TXN_KEY, "left")
        .join(sessions, TXN_KEY)
        .groupBy(*TXN_KEY, "session_id", "posted_text", *LABELS)
        .agg(F.sum(amount).alias("amount"))
    )


def with_traits(
    tables: Tables, params: ReportParams, lines: DataFrame, dates: list[date]
) -> DataFrame:
    """Tender lines with the traits of their transaction, 0 without sale lines."""
    traits = sale_traits(tables, params, dates)
    return lines.join(traits, TXN_KEY, "left").fillna({"traits": 0})


def tender_payments(
    tables: Tables, params: ReportParams, lines: DataFrame, posted: DataFrame,
    dates: list[date], attach: Attach, named: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Payments of all departments, with their references attached and added up in one pass.

    ``named`` adds the number of the user as ``pid``, before rows are repeated for references.
    """
    payments = biller_payments(tables, params, lines.drop("traits"), dates).unionByName(
        accessory_payments(tables, params, lines, posted, dates)
    )
    also = ["pid"] if named else []
    # the posted text separates sums but is not shown
    totals = _totals(
        attach(named(payments) if named else payments), *also, "posted_text"
    ).drop("posted_text")
    return totals.filter((F.col("department") != params.codes.accessory) | (F.col("amount") != 0))


def biller_payments(
    tables: Tables, params: ReportParams, lines: DataFrame, dates: list[date]
) -> DataFrame:
    """CORE, MOBILE DEVICE and MOBILE SERVICE payments from one pass over the tender lines."""
    codes = params.codes

    def department(name: str, count: str, scope: str, seq):
        return F.struct(
            F.lit(name).alias("department"), F.col(count).alias("n"),
            F.lit(scope).alias("bag_scope"), seq.alias("bag_seq"),
        )

    own = F.col("trans_seq")
    departments = F.array(
        department(codes.core, "n_core", SESSION, F.lit(0).cast("bigint")),
        department(codes.device, "n_device", TRANSACTION, own),
        department(codes.service, "n_service", TRANSACTION, own),
    )
    return (
        posted_amounts(tables, params, lines, dates)
        .join(biller_counts(tables, params, dates), STORE_TXN_KEY)
        .withColumn("d", F.explode(F.filter(departments, lambda d: d["n"] > 0)))
        .select(
            "*", "d.department", "d.bag_scope", "d.bag_seq",
            (F.col("amount") * F.col("d.n")).cast("decimal(38,6)").alias("billed"),
        )
        .groupBy(
            "organization_id", *BAG_KEY, "department", "billerid", "posted_text", *LABELS
        )
        .agg(F.sum("billed").alias("amount"))
    )


def posted_elsewhere(tables: Tables, params: ReportParams, lines: DataFrame) -> DataFrame:
    """Amounts posted on any date for a store, sequence and line that ``lines`` has.

    They come from the index of posted amounts where one is stored for the run's codes, and else
    from all line properties.
    """
    derived = posted_index(params.codes)
    posted = tables.get(derived.name)
    if posted is None:
        posted = derived.build(tables[derived.source])
    return (
        posted.filter(F.col("organization_id") == params.organization_id)
        .select(*SEQUENCE_LINE, "wkstn_id", "decimal_value")
        .join(lines.select(*SEQUENCE_LINE).distinct(), SEQUENCE_LINE, "left_semi")
    )


def mark_posted_here(lines: DataFrame, posted: DataFrame) -> DataFrame:
    """Lines with ``posted_here``: true where their own workstation posted, else NULL."""
    at_workstation = posted.select(*SEQUENCE_LINE, "wkstn_id").distinct()
    flagged = at_workstation.withColumn("posted_here", F.lit(True))
    return lines.join(flagged, [*SEQUENCE_LINE, "wkstn_id"], "left")


def accessory_payments(
    tables: Tables, params: ReportParams, lines: DataFrame, posted: DataFrame, dates: list[date]
) -> DataFrame:
    """What is left of tender amounts after posting, for transactions with accessory sales.

    Posted amounts match by store, sequence and line on any date and workstation; a line
    without one on its own workstation counts whole.  Transactions match without workstation.
    """
    codes, line = params.codes, SEQUENCE_LINE
    candidates = lines.filter(F.col("amt").isNotNull() & has_trait(ACCESSORY))
    remainders = mark_posted_here(
        surplus_over(candidates, posted, line, "amt", "decimal_value", "remainder"), posted
    )
    zero = F.lit(0).cast("decimal(38,6)")
    whole = F.when(F.col("posted_here").isNull(), F.col("amt")).otherwise(zero)
    contribution = (F.coalesce("remainder", zero) + whole).cast("decimal(38,6)")
    per_transaction = (
        remainders.withColumn("left_over", contribution)
        .filter(F.col("left_over") != 0)
        .groupBy(*TXN_KEY, *LABELS)
        .agg(F.sum("left_over").alias("left_over"))
    )
    sequence = ["organization_id", "rtl_loc_id", "business_date", "trans_seq"]
    sessions = (
        on_dates(tables["trn_trans"], dates)
        .groupBy(*sequence, "session_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_transaction.join(sessions, sequence)
        .withColumn("bag_scope", F.lit(SESSION))
        .withColumn("bag_seq", F.lit(0).cast("bigint"))
        .groupBy("organization_id", *BAG_KEY, *LABELS)
        .agg(F.sum((F.col("left_over") * F.col("n")).cast("decimal(38,6)")).alias("amount"))
        .withColumn("department", F.lit(codes.accessory))
        .withColumn("billerid", F.lit(None).cast("string"))
        .withColumn("posted_text", F.lit(None).cast("string"))
    )


def _totals(payments: DataFrame, *hidden: str) -> DataFrame:
    return payments.groupBy(
        F.col("rtl_loc_id").alias("locationid"), "trans_date", "department", "billerid",
        "payment_type", "deposit_ref", "create_user_id", *hidden,
    ).agg(F.sum("amount").cast(TOTAL).alias("amount"))


def session_bags(tables: Tables, dates: list[date]) -> DataFrame:
    """Bags that left a session, for each workstation the session ran on."""
    store_session = ["organization_id", "rtl_loc_id", "session_id"]
    controls = (
        on_dates(tables["tsn_tndr_control_trans"], dates)
        .filter(F.col("safe_bag_id").isNotNull())
        .select(
            "organization_id", "rtl_loc_id", "business_date", "trans_seq", "safe_bag_id",
            F.col("outbound_session_id").alias("session_id"),
        )
    )
    workstations = tables["tsn_session_wkstn"].select(*store_session, "wkstn_id")
    return (
        controls.join(workstations, store_session)
        .select("rtl_loc_id", "business_date", "wkstn_id", "session_id", "trans_seq", "safe_bag_id")
        .distinct()
    )


def bag_references(tables: Tables, dates: list[date]) -> Attach:
    """Deposits name each bag of their session or transaction, with the whole amount.

    Other tenders hide the bag, so they are multiplied by the number of bags instead.  Payments
    get their bags in lists and are repeated only where all rows that are added up, or may be
    equal then, lie in one task: repeated rows are not exchanged.
    """
    scopes = F.array(
        F.struct(F.lit(SESSION).alias("bag_scope"), F.lit(0).cast("bigint").alias("bag_seq")),
        F.struct(F.lit(TRANSACTION).alias("bag_scope"), F.col("trans_seq").alias("bag_seq")),
    )
    bags = (
        session_bags(tables, dates)
        .withColumn("scope", F.explode(scopes))
        .select("*", "scope.*")
        .select(*BAG_KEY, "safe_bag_id")
        .distinct()
    )
    # one row for each bag, and one for all bags of a key
    sets = [[*BAG_KEY, "safe_bag_id"], BAG_KEY]
    references = (
        bags.groupingSets(sets, *BAG_KEY, "safe_bag_id")
        .agg(F.count("*").alias("bags"), F.grouping("safe_bag_id").alias("_all"))
        .select(
            *BAG_KEY, (F.col("_all") == 0).alias("is_deposit"),
            F.col("safe_bag_id").alias("deposit_ref"), "bags",
        )
    )

    key = [*BAG_KEY, "is_deposit"]
    place = F.row_number().over(W.partitionBy(*key).orderBy("deposit_ref")) - 1
    lists = (
        references.withColumn("list", F.floor(place / LISTED_BAGS))
        .groupBy(*key, "list")
        .agg(F.collect_list("deposit_ref").alias("deposit_refs"), F.max("bags").alias("bags"))
        .drop("list")
    )

    def attach(payments: DataFrame) -> DataFrame:
        times = F.coalesce("bags", F.lit(1))
        listed = payments.join(lists, key, "left").withColumn(
            "amount", (F.col("amount") * times).cast("decimal(38,6)")
        )
        # a fixed number: few bytes here may be many repeated rows, so tasks are not merged
        parts = int(payments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        together = listed.drop("bags", *set(BAG_KEY) - set(SHOWN)).repartition(parts, *SHOWN)
        return together.withColumn("deposit_ref", F.explode_outer("deposit_refs"))

    return attach


STORE_DAY = ["organization_id", "rtl_loc_id", "business_date"]


def deposit_listings(tables: Tables, params: ReportParams, dates: list[date]) -> DataFrame:
    """All smart-safe deposits of each store and business date, with their key."""
    numbers = on_dates(tables["trn_trans_p"], dates).filter(
        code_like(F.col("property_code"), params.codes.deposit_id)
    )
    return keyed_listing(ordered_listing(numbers, STORE_DAY, "string_value", "listing"))


def listing_references(listings: DataFrame) -> tuple[Attach, DataFrame]:
    """Deposits name the listing of their store and business date.

    A listing is as long as a day has deposits, so payments carry its key only; the second
    result has the texts by store and key.
    """
    keys = listings.drop("listing")

    def attach(payments: DataFrame) -> DataFrame:
        return payments.join(keys, STORE_DAY, "left").withColumn(
            "deposit_ref", deposit_only(F.col("is_deposit"), F.col("listing_key"))
        )

    return attach, texts_of(listings)


def texts_of(listings: DataFrame) -> DataFrame:
    return listings.select(F.col("rtl_loc_id").alias("locationid"), "listing_key", "listing")


def keyed_listing(listings: DataFrame) -> DataFrame:
    """Equal listings have the same short key, and others have others."""
    return listings.withColumn("listing_key", F.sha2("listing", 256))


def ordered_with_listings(
    rows: DataFrame, order: list[str], texts: Mapping[tuple[str, ...], DataFrame]
) -> DataFrame:
    """Rows by ``order``, store and department, with the text in place of its key.

    ``texts`` has the texts that rows of some departments can name.  A text is sent to the tasks
    whose rows name it and handed to the rows where they lie in order, so no row is exchanged or
    sorted with its text.  Rows with the same text are written one after another, and a task has
    no more texts than a columnar file stores once (``listing_places``).
    """
    key = [*order, "deposit_ref"]
    columns = rows.columns
    rows = stage(rows, "rows")
    groups = rows.groupBy(*key).agg(F.count("*").alias("rows"))
    named = stage(_named_texts(groups, key, texts), "texts")
    places = stage(listing_places(groups, named, order), "places")
    tasks = 1 + (places.agg(F.max("last")).first()[0] or 0)

    at = places.withColumnsRenamed({name: f"_{name}" for name in key})
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in key])
    spread = F.pmod(F.xxhash64(*columns), F.col("last") - F.col("first") + 1)
    placed = rows.join(at, same).select(
        *columns, (F.col("first") + spread).cast("int").alias("place"),
        F.lit(False).alias("is_text"),
    )
    sent = named.join(places, key).select(
        *key, "listing", F.explode(F.sequence("first", "last")).alias("place"),
        F.lit(True).alias("is_text"),
    )
    together = W.partitionBy("place", *key)
    return (
        placed.unionByName(sent, allowMissingColumns=True)
        .repartitionById(tasks, "place")
        .withColumn("listing", F.first("listing", ignorenulls=True).over(together))
        .filter(~F.col("is_text"))
        .withColumn("deposit_ref", F.col("listing"))
        .select(*columns)
    )


def _named_texts(
    groups: DataFrame, key: list[str], texts: Mapping[tuple[str, ...], DataFrame]
) -> DataFrame:
    """(key, listing) of the texts that rows name, once for each department."""
    places = []
    for departments, found in texts.items():
        once = found.groupBy("locationid", "listing_key").agg(F.first("listing").alias("listing"))
        places.append(once.select(
            "locationid", F.explode(F.array(*[F.lit(name) for name in departments]))
            .alias("department"),
            F.col("listing_key").alias("deposit_ref"), "listing",
        ))
    every = reduce(DataFrame.unionByName, places).join(groups.select(*key), key, "left_semi")
    # a fixed number: few bytes here may be much text, so tasks are not merged
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, *key)


def listing_places(groups: DataFrame, named: DataFrame, order: list[str]) -> DataFrame:
    """(key, first, last): the tasks, numbered by ``order``, for the rows of each listing.

    A columnar writer looks at its memory every so many rows, as many as seem to fit by those it
    has seen.  Rows without a text make that many, so long texts after them are held for all these
    rows at once; and texts are stored once only while a file has few.  So rows with long texts
    have tasks of their own, with at most ``TASK_TEXT`` bytes that end in them, and rows with none
    or short ones have others.  Tasks are numbered by running sums within a store and department,
    and of these.  A listing that is more than a task shares none: it takes as many as it needs.
    """
    key = [*order, "deposit_ref"]
    sizes = named.groupBy(*key).agg(F.max(F.octet_length("listing")).alias("bytes"))
    length = F.coalesce("bytes", F.lit(0)).cast("bigint")
    weight = length + F.col("rows") * ROW_WEIGHT + F.floor(F.col("rows") * length / COPIED)
    lots = F.ceil(F.col("weight") / TASK_TEXT)
    sized = groups.join(sizes, key, "left").select(
        *key, (length > LONG_TEXT).alias("long"), weight.alias("weight")
    ).withColumn("shared", ~F.col("long") | (F.col("weight") <= TASK_TEXT)).withColumn(
        "weight", F.when(F.col("shared"), F.col("weight")).otherwise(lots * TASK_TEXT)
    )
    block = [*order, "long", "shared"]
    inside = W.partitionBy(*block).orderBy("deposit_ref").rowsBetween(W.unboundedPreceding, 0)
    # at most three rows for a store and department
    blocks = sized.groupBy(*block).agg(F.sum("weight").alias("all"))
    before = W.orderBy(*order, F.desc("long"), "shared").rowsBetween(W.unboundedPreceding, -1)

    def full(weights: Column) -> Column:
        """The task in which so much ends."""
        return F.floor((weights - 1) / TASK_TEXT)

    def sofar(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    short = sofar(F.when(~F.col("long"), F.col("all")))
    long = sofar(F.when(F.col("long"), full(F.col("all")) + 2))
    starts = blocks.select(
        *[F.col(name).alias(f"_{name}") for name in block],
        F.when(F.col("long"), F.lit(0)).otherwise(short).alias("start"),
        (long + F.when(F.col("long"), full(short) + 1).otherwise(0)).alias("base"),
    )
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in block])
    end = F.col("start") + F.col("sum")
    last = F.col("base") + full(end)
    former = F.col("base") + full(end - F.col("weight"))
    return sized.withColumn("sum", F.sum("weight").over(inside)).join(starts, same).select(
        *key, F.least(last, former + 1).cast("int").alias("first"), last.cast("int").alias("last")
    )
