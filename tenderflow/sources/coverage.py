"""What is known about the files of a stored table, and tables derived from it by date.

``write_tables`` notes each file it has written with its size and its range of creation times, and
derives small tables that a run would else compute from all dates.  Files may be added, replaced or
taken away later by anybody.  So reading starts from the files that are there: one that is not
noted counts as having any creation time, and a date whose files are not exactly those noted is
derived anew from the table itself.  Nothing has to be refreshed for right results; refreshing
only makes reading cheaper again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.codes import Codes

DATE = "business_date"
NOTED = "business_date date, file string, size bigint, first timestamp, last timestamp"

#: a line of a store's sequence, on any date and workstation
SEQUENCE_LINE = ["organization_id", "rtl_loc_id", "trans_seq", "rtrans_lineitm_seq"]


def files_of(name: str) -> str:
    """Where the files of a table are noted."""
    return f"{name}_files"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def current_files(spark: SparkSession, folder: str) -> DataFrame:
    """(business_date, file, size) of the files a table has now; none of them is opened.

    A session of its own reads the list, so that it isn't split by the bytes it does not read.
    """
    lister = spark.newSession()
    lister.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 40))
    found = lister.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    day = F.col(DATE) if DATE in found.columns else F.lit(None)
    return found.select(
        day.cast("date").alias(DATE), F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("length").alias("size"),
    )


def note_files(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """The files of a table just written, with their creation times if the table has any."""
    if "create_date" not in stored.columns:
        unknown = F.lit(None).cast("timestamp")
        return listed.select("*", unknown.alias("first"), unknown.alias("last"))
    file = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")]
    return stored.groupBy(DATE, *file).agg(
        F.min("create_date").alias("first"), F.max("create_date").alias("last")
    )


def created_ranges(current: DataFrame, noted: DataFrame) -> DataFrame:
    """(business_date, first, last) for each file there is now; NULL times where none are noted."""
    # a task's files have the same name in each date's folder
    known = noted.select(DATE, "file", "size", "first", "last")
    return current.join(known, [DATE, "file", "size"], "left").select(DATE, "first", "last")


def changed_dates(current: DataFrame, noted: DataFrame) -> list[date]:
    """Dates that have other files now than were noted; there are no more than days."""
    both = current.select(DATE, "file", "size", F.lit(1).alias("side")).unionByName(
        noted.select(DATE, "file", "size", F.lit(-1).alias("side"))
    )
    files = both.groupBy(DATE, "file", "size").agg(F.sum("side").alias("off")).filter("off <> 0")
    return sorted(row[0] for row in files.select(DATE).dropna().distinct().collect())


@dataclass(frozen=True)
class Derived:
    """A table made of another one date by date; ``bucketed`` by ``keys`` or split by date."""

    source: str
    name: str
    build: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()


def posted_index(codes: Codes) -> Derived:
    """Posted amounts by store, sequence and line: a small part of all line properties, in the
    order in which a run looks them up for any date."""
    def build(properties: DataFrame) -> DataFrame:
        return properties.filter(F.col("property_code") == codes.posted_amount).select(
            DATE, *SEQUENCE_LINE, "wkstn_id", "decimal_value"
        )

    return Derived(
        "trl_rtrans_lineitm_p", f"posted-{codes.posted_amount}", build, tuple(SEQUENCE_LINE)
    )


def _media(counts: DataFrame) -> DataFrame:
    return media_sums(
        counts.filter(F.coalesce("media_count", F.lit(0)) != 0).withColumn("n", F.lit(1))
    )


def media_sums(counts: DataFrame) -> DataFrame:
    """Counts with media by date, sequence, tender and difference; such sums add up."""
    difference = F.col("difference_amt").cast("decimal(18,6)").alias("difference_amt")
    return counts.groupBy(DATE, "organization_id", "trans_seq", "tndr_id", difference).agg(
        F.sum("n").cast("bigint").alias("n")
    )


MEDIA = Derived("tsn_tndr_tndr_count", "media-sums", _media)


def fresh(
    derived: Derived, source: DataFrame, stored: DataFrame, changed: list[date]
) -> DataFrame:
    """The derived table as it would be made now: stored rows of dates that have not changed, and
    for the others, and rows without a date, what their files give."""
    day = F.col(DATE)
    again = derived.build(source.filter(day.isin(changed) | day.isNull()))
    kept = stored.filter(day.isNotNull() & ~day.isin(changed))
    return kept.select(*again.columns).unionByName(again)
