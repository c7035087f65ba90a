"""Over and short: differences of till end counts.

A count row belongs to an end count in one of two ways.  Counts with media belong to every
end count with their sequence, in whatever store or organization and on whatever date; counts
without media only to their own transaction, if they differ.  The media flag splits the count
rows, so the two ways never give the same pair and each is one equality join.  Counts are
added up per sequence before they meet the end counts, so no pair is formed; sums of each date
can be stored with the data and are added up when read.
With ``strict_keys`` every count belongs to its own transaction only.
"""

from __future__ import annotations

from datetime import date


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import code_like, day_text
from tenderflow.operators import asked, on_dates, ordered_listing
from tenderflow.params import ReportParams
from tenderflow.plans.shared import Tables
from tenderflow.plans.tenders import keyed_listing, texts_of
from tenderflow.schemas import TOTAL, TXN_KEY
from tenderflow.sources.coverage import MEDIA

EXACT = "decimal(18,6)"
SUM = "decimal(28,6)"


def asked_ends(tables: Tables, params: ReportParams) -> DataFrame:
    return asked(tables, "tsn_tndr_control_trans", params).filter(
        F.upper("typcode") == params.codes.end_count
    ).select(*TXN_KEY, "outbound_session_id", "amt", "create_date", "create_user_id")


def of_sessions(tables: Tables, ends: DataFrame) -> DataFrame:
    """End counts of known sessions."""
    sessions = tables["tsn_session"].select(
        "organization_id", "rtl_loc_id", F.col("session_id").alias("outbound_session_id")
    )
    return ends.join(sessions, ["organization_id", "rtl_loc_id", "outbound_session_id"])


def own_counts(tables: Tables, dates: list[date] | None, strict: bool) -> DataFrame:
    """Count rows that belong to their own transaction only, on some dates or on all."""
    rows = tables["tsn_tndr_tndr_count"]
    counts = (rows if dates is None else on_dates(rows, dates)).select(
        *TXN_KEY, "tndr_id", F.col("difference_amt").cast(EXACT).alias("difference"),
        (F.coalesce("media_count", F.lit(0)) != 0).alias("has_media"),
    )
    differs, has_media = F.col("difference") != 0, F.col("has_media")
    wanted = differs | has_media if strict else differs & ~has_media
    return _of_known_tenders(tables, counts.filter(wanted).drop("has_media"))


def media_counts(tables: Tables, ends: DataFrame, strict: bool) -> DataFrame:
    """Different counts with media, and their number ``n``, for each sequence of ``ends``.

    Counts of any date can match.  They are added up by date where that is stored, and here
    otherwise; those of other sequences go at once.
    """
    sums = tables.get(MEDIA.name)
    if sums is None:
        sums = MEDIA.build(tables[MEDIA.source])
    asked = ends.select("trans_seq").distinct()
    counts = sums.filter(F.lit(not strict)).join(asked, "trans_seq", "left_semi").select(
        "organization_id", "trans_seq", "tndr_id", F.col("difference_amt").alias("difference"), "n"
    )
    return _of_known_tenders(tables, counts)


def _of_known_tenders(tables: Tables, counts: DataFrame) -> DataFrame:
    """Rows of tenders their organization has, as often as it has them."""
    tenders = tables["tnd_tndr"].select("organization_id", "tndr_id")
    return counts.join(tenders, ["organization_id", "tndr_id"])


def matched_counts(ends: DataFrame, own: DataFrame, media: DataFrame) -> DataFrame:
    """Per end count and tender: matched count rows and the sum of their differences.

    An end count can get two rows of a tender, one for either way of matching.
    """
    by_key = own.groupBy(*TXN_KEY, "tndr_id").agg(
        F.count("*").alias("matches"), F.sum("difference").cast(SUM).alias("difference")
    )
    by_sequence = media.groupBy("trans_seq", "tndr_id").agg(
        F.sum("n").alias("matches"),
        F.sum((F.col("difference") * F.col("n")).cast(SUM)).cast(SUM).alias("difference"),
    )
    columns = [*ends.columns, "tndr_id", "matches", "difference"]
    return ends.join(by_key, TXN_KEY).select(*columns).unionByName(
        ends.join(by_sequence, "trans_seq").select(*columns)
    )


def count_differences(
    tables: Tables, params: ReportParams, ends: DataFrame, dates: list[date]
) -> DataFrame:
    """Differences by tender, moment, store and user, as plain treasury rows."""
    strict = params.strict_keys
    matched = matched_counts(
        ends.select(*TXN_KEY, "create_date", "create_user_id"),
        own_counts(tables, dates, strict), media_counts(tables, ends, strict),
    )
    return _rows(matched, F.lit(None).cast("string"), params)


def safe_differences(
    tables: Tables, params: ReportParams, ends: DataFrame, dates: list[date]
) -> tuple[DataFrame, DataFrame]:
    """The same for smart safes: differences of one end count are merged when equal.

    Rows name the listing of their transaction's deposits by its key; the second result has
    the texts by store and key.

    Kiosk differences (taken in by the safe minus expected) join them before the merge.  The
    different media differences of a sequence are summed once per sequence; what an end count
    has of its own is added unless its sequence already holds an equal one.
    """
    codes = params.codes
    end = [*TXN_KEY, "create_date", "create_user_id"]
    identities = ends.select(*end).distinct()
    known = F.col("difference").isNotNull()

    properties = on_dates(tables["trn_trans_p"], dates)
    at_kiosk = properties.filter(F.col("string_value") == codes.kiosk_marker).select(*TXN_KEY)
    taken = properties.filter(code_like(F.col("property_code"), codes.deposit_amount)).select(
        *TXN_KEY, "decimal_value"
    )
    kiosk = (
        ends.join(at_kiosk, TXN_KEY, "left_semi")
        .join(taken, TXN_KEY)
        .select(
            *end, F.lit(codes.cash_tender).alias("tndr_id"),
            (F.col("decimal_value") - F.col("amt")).cast(EXACT).alias("difference"),
        )
        .filter(F.col("difference").isNotNull())
    )
    own = own_counts(tables, dates, params.strict_keys).filter(known)
    singles = (
        identities.join(own.select(*TXN_KEY, "tndr_id", "difference"), TXN_KEY)
        .select(*end, "tndr_id", "difference")
        .unionByName(kiosk)
        .distinct()
    )
    shared = (
        media_counts(tables, ends, params.strict_keys).filter(known)
        .select("trans_seq", "tndr_id", "difference")
        .distinct()
    )
    shared_totals = shared.groupBy("trans_seq", "tndr_id").agg(
        F.sum("difference").alias("difference")
    )
    merged = singles.join(shared, ["trans_seq", "tndr_id", "difference"], "left_anti").select(
        *end, "tndr_id", "difference"
    ).unionByName(
        identities.join(shared_totals, "trans_seq").select(*end, "tndr_id", "difference")
    )
    deposits = keyed_listing(ordered_listing(
        properties.filter(code_like(F.col("property_code"), codes.deposit_id)),
        TXN_KEY, "string_value", "listing",
    ))
    keyed = merged.join(deposits.drop("listing"), TXN_KEY, "left")
    return _rows(keyed, F.col("listing_key"), params), texts_of(deposits)


def _rows(matched: DataFrame, reference, params: ReportParams) -> DataFrame:
    moment = F.col("create_date")
    totals = (
        matched.groupBy(
            "tndr_id", "create_date", "rtl_loc_id", "create_user_id",
            reference.alias("deposit_ref"),
        )
        .agg(F.sum("difference").cast(TOTAL).alias("amount"))
        .filter(F.col("amount") != 0)
    )
    # the moment separates sums but only its day is shown
    return totals.select(
        F.col("rtl_loc_id").alias("locationid"), "amount", day_text(moment).alias("trans_date"),
        F.lit(params.codes.over_short).alias("department"),
        F.lit(None).cast("string").alias("billerid"), F.col("tndr_id").alias("payment_type"),
        "deposit_ref", "create_user_id",
    )
