"""Writing statements: cells as text, dated output folders, the note for an empty report."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The note and the date labels of the outputs.
NO_DATA = "No data available for the selected date."
DAILY, WEEKLY = "daily", "weekly"
LABEL_PATTERN = {DAILY: "dd_MMMM_yyyy", WEEKLY: "MMMM_yyyy"}

#: folder within a report for texts that its rows name by key
TEXTS = "_texts"

_NATIVE = (T.StringType, T.IntegerType, T.DoubleType, T.BooleanType)


def cell(field: T.StructField) -> Column:
    """Text, whole numbers of 32 bits, doubles and booleans stay; all else becomes text."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _NATIVE):
        return column
    text = column.cast("string")
    if isinstance(field.dataType, T.DecimalType) and field.dataType.scale > 0:
        # a number's text has no trailing zeros
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return text.alias(field.name)


def render_cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell(field) for field in df.schema.fields])


def empty_note(df: DataFrame) -> DataFrame:
    """What stands for ``df`` when it has no rows: the message in its first cell."""
    first, *others = df.columns
    return df.sparkSession.range(1).select(
        F.lit(NO_DATA).alias(first), *[F.lit(None).cast("string").alias(name) for name in others]
    )


def output_path(report: Column, as_of: Column, period: str) -> Column:
    """Where a run writes; a later run of the same label replaces the earlier one."""
    label = F.date_format(as_of, LABEL_PATTERN[period])
    return F.concat(F.lit("report="), report, F.lit("/as_of="), label)


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", placeholder: bool = False,
    texts: DataFrame | None = None,
) -> int:
    """Write a report as text cells and return its row count, taken during the write.

    It is written beside ``path`` and takes its place when it is whole, so a former output stays
    as it was until then, also if the write fails.

    Long texts that many rows share are written once, as in a workbook: ``texts`` has a column of
    ``df``, whose cells hold keys, and the text of each key.  Those the rows name go to a folder
    within that readers of the rows skip; ``read_report`` puts them in place.
    """
    counted = Observation()
    rows = render_cells(df).observe(counted, F.count(F.lit(1)).alias("rows"))
    with replacing(df.sparkSession, path) as beside:
        _write(rows, beside, fmt)
        count = counted.get["rows"]
        if count == 0 and placeholder:
            _write(empty_note(df), beside, fmt, header=False)
        if count and texts is not None:
            column, text = texts.columns
            named = _read(df.sparkSession, beside, fmt).select(column).distinct()
            once = texts.groupBy(column).agg(F.first(text).alias(text))
            _write(once.join(named, column, "left_semi"), f"{beside}/{TEXTS}", fmt)
    return count


def read_report(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The cells of a written report, with shared texts in place of their keys."""
    rows = _read(spark, path, fmt)
    within = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, TEXTS)
    store = within.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(within):
        return rows
    texts = _read(spark, within.toString(), fmt)
    column, text = texts.columns
    shared = texts.select(F.col(column).alias("_key"), F.col(text).alias("_text"))
    joined = rows.join(shared, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(column, F.col("_text")).select(*[F.col(f"`{c}`") for c in rows.columns])


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).option("header", True).load(path)


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A hidden folder beside ``path`` that takes its place if all goes well.

    The former folder is first named aside and goes last, so at each moment one of the two is
    whole; if the new one can't be put in place, the former one is put back.
    """
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    beside = Path(target.getParent(), f".new-{mark}")
    aside = Path(target.getParent(), f".old-{mark}")
    try:
        yield beside.toString()
        if not store.exists(beside):
            raise OSError(f"nothing was written for {path}")
        former, placed = store.exists(target), False
        if former and not store.rename(target, aside):
            raise OSError(f"{path} can't be replaced")
        try:
            placed = store.rename(beside, target)
        finally:
            if former and not placed:
                store.rename(aside, target)
        if not placed:
            raise OSError(f"{path} can't be written")
        if former:
            store.delete(aside, True)
    except BaseException:
        store.delete(beside, True)
        raise


def _write(df: DataFrame, path: str, fmt: str, header: bool = True) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", header).csv(path)
    else:
        writer.format(fmt).save(path)
