"""Joins on transaction, session and version keys."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.codes import Codes
from tenderflow.functions import asked_rows, nth_run
from tenderflow.params import ReportParams
from tenderflow.sources.tables import created_of


def asked(tables: Mapping[str, DataFrame], name: str, params: ReportParams) -> DataFrame:
    """Rows of a table with a creation time that belong to the run.

    Where the creation times of the table's files are noted, only partitions of dates that can
    have such rows are read, and those with files nobody has noted.
    """
    rows = tables[name]
    ranges = tables.get(created_of(name))
    if ranges is not None:
        first = F.lit(params.window.start).cast("timestamp")
        after = F.lit(params.window.end + timedelta(days=1)).cast("timestamp")
        # a file without known times may have any
        latest, earliest = F.coalesce("last", first), F.coalesce("first", first)
        dates = ranges.filter((latest >= first) & (earliest < after))
        undated = rows.filter(F.col("business_date").isNull())
        rows = on_dates(rows, business_dates(dates)).unionByName(undated)
    return rows.filter(asked_rows(params))


def business_dates(df: DataFrame) -> list[date]:
    """The business dates some rows have: never more than the calendar has days.

    They are known before the rest of a report is planned, so that every other table is
    pruned to its partitions of these dates when it is listed, not only when it is read.
    """
    dates = df.select("business_date").dropna().distinct()
    return sorted(row.business_date for row in dates.collect())


def on_dates(df: DataFrame, dates: list[date]) -> DataFrame:
    """Rows of some business dates; rows of any other date cannot join what is asked for."""
    return df.filter(F.col("business_date").isin(dates))


def original_transactions(properties: DataFrame, codes: Codes) -> DataFrame:
    """Keys of transactions that a reversal line of the same store and business date names.

    The link text holds the workstation and the sequence as its fourth and fifth part.  A link
    that is too short, or not numeric there, names nothing.
    """
    link = F.col("string_value")
    return (
        properties.filter(F.col("property_code") == codes.reversal_link)
        .select(
            "organization_id", "rtl_loc_id", "business_date",
            nth_run(link, ":", 4).try_cast("bigint").alias("wkstn_id"),
            nth_run(link, ":", 5).try_cast("bigint").alias("trans_seq"),
        )
        .dropna()
        .distinct()
    )


def session_matches(controls: DataFrame, sessions: DataFrame, how: str = "inner") -> DataFrame:
    """Join on "the session is the outbound or the inbound one" as one equality.

    Each control row is looked up under its one or two session ids, so a pair appears once
    even when both ids are equal.
    """
    ids = F.array_distinct(F.array("outbound_session_id", "inbound_session_id"))
    return controls.withColumn("session_id", F.explode(ids)).join(
        sessions, ["organization_id", "rtl_loc_id", "session_id"], how
    )
