"""Reading the point-of-sale tables from files or from a database."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderflow.codes import Codes
from tenderflow.params import Window
from tenderflow.schemas import DATED_TABLES, DDL, TABLES, schema
from tenderflow.sources.coverage import (
    MEDIA,
    NOTED,
    Derived,
    changed_dates,
    created_ranges,
    current_files,
    exists,
    files_of,
    fresh,
    note_files,
    posted_index,
)

Reader = Callable[[str], DataFrame]
#: dated tables whose rows are asked for by creation time
CREATED_TABLES = tuple(name for name in DATED_TABLES if "create_date" in DDL[name])
#: parts of a derived table that is stored in the order of its keys
BUCKETS = 64


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a table in their declared types, whatever the source's case."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name)])


def created_of(name: str) -> str:
    """Where a table's ranges of creation times are: for each file its date, first and last."""
    return f"{name}_created"


def load_tables(
    reader: Reader, names: Iterable[str] = TABLES, codes: Codes | None = None
) -> dict[str, DataFrame]:
    """The tables, and what the reader knows about them: the creation times of their files, and
    tables derived from them for ``codes``."""
    tables = {name: conform(reader(name), name) for name in names}
    if isinstance(reader, ParquetReader):
        # after the tables, so that no file of theirs is missing in the lists of files
        for name in CREATED_TABLES:
            if name in tables and (found := reader.created(name)) is not None:
                tables[created_of(name)] = found
        for derived in derived_tables(codes or Codes()):
            source = tables.get(derived.source)
            if source is not None and (found := reader.derived(derived, source)) is not None:
                tables[derived.name] = found
    return tables


def derived_tables(codes: Codes) -> list[Derived]:
    return [posted_index(codes), MEDIA]


class ParquetReader:
    """One folder per table; the schema is declared, so nothing is read to infer it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.schema(schema(name)).parquet(f"{self.root}/{name}")

    def created(self, name: str) -> DataFrame | None:
        """The creation times of the files there are, or None for tables written otherwise."""
        noted = f"{self.root}/{files_of(name)}"
        if not exists(self.spark, noted):
            return None
        now = current_files(self.spark, f"{self.root}/{name}")
        return created_ranges(now, self.spark.read.schema(NOTED).parquet(noted))

    def derived(self, derived: Derived, source: DataFrame) -> DataFrame | None:
        """A derived table as the files of its source are now, or None if there is none stored."""
        folder = f"{self.root}/{derived.name}"
        if not exists(self.spark, f"{folder}/files"):
            return None
        columns = derived.build(source).schema
        if derived.keys:
            stored = self._bucketed(f"{folder}/rows", columns, derived.keys)
        else:
            stored = self.spark.read.schema(columns).parquet(f"{folder}/rows")
        now = current_files(self.spark, f"{self.root}/{derived.source}")
        noted = self.spark.read.schema(NOTED).parquet(f"{folder}/files")
        return fresh(derived, source, stored, changed_dates(now, noted))

    def _bucketed(self, folder: str, columns: StructType, keys: tuple[str, ...]) -> DataFrame:
        """A table whose rows Spark knows to lie in buckets; its entry in the session's catalog
        only names the folder."""
        name = f"tenderflow_{uuid.uuid4().hex}"
        parts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
        ordered = ", ".join(keys)
        self.spark.sql(
            f"create table {name} ({parts}) using parquet clustered by ({ordered}) "
            f"sorted by ({ordered}) into {BUCKETS} buckets location '{folder}'"
        )
        return self.spark.table(name)


def parquet_reader(spark: SparkSession, root: str) -> ParquetReader:
    return ParquetReader(spark, root)


def write_tables(
    tables: Mapping[str, DataFrame], root: str, codes: Codes | None = None, *,
    grouped: bool = False,
) -> None:
    """Store tables the way the statements like them: dated ones partitioned by business date.

    Rows are asked for by creation time, which may be far from their business date, so the
    first and last of each file are noted too; a run then opens the dates that can have its
    rows and no others, however late a row was made.  Amounts and counts that match on any date
    are derived into small tables.  Files may come and go later; see ``sources.coverage``.
    ``grouped`` rows, whose stores and dates lie together already, are not exchanged to be
    written; each task has a file for each of its dates.
    """
    for name in [name for name in tables if name in TABLES]:
        _write(tables[name], root, name, "overwrite", grouped)
        refresh(tables[name].sparkSession, root, name, codes)


def append_rows(df: DataFrame, root: str, name: str, *, grouped: bool = False) -> None:
    """Add rows to a stored table, of new dates or of old ones; nothing has to be refreshed."""
    _write(df, root, name, "append", grouped)


def _write(df: DataFrame, root: str, name: str, mode: str, grouped: bool) -> None:
    if name in DATED_TABLES:
        order = ["business_date", "rtl_loc_id", "trans_seq"]
        spread = df if grouped else df.repartitionByRange(*order)
        spread.write.mode(mode).partitionBy("business_date").parquet(f"{root}/{name}")
    else:
        df.write.mode(mode).parquet(f"{root}/{name}")


def refresh(spark: SparkSession, root: str, name: str, codes: Codes | None = None) -> None:
    """Note the files a stored table has now, and derive again what is derived from it.

    Never needed for right results.  While it runs, no files of the table should be written.
    """
    reader = ParquetReader(spark, root)
    if name in CREATED_TABLES:
        listed = current_files(spark, f"{root}/{name}")
        _one_file(note_files(reader(name), listed), f"{root}/{files_of(name)}")
    for derived in derived_tables(codes or Codes()):
        if derived.source == name:
            _write_derived(reader, derived, f"{root}/{derived.name}")


def _write_derived(reader: ParquetReader, derived: Derived, folder: str) -> None:
    """The files are listed before the rows are read, so rows can only be newer than the list."""
    source = conform(reader(derived.source), derived.source)
    listed = current_files(reader.spark, f"{reader.root}/{derived.source}")
    rows = derived.build(source.filter(F.col("business_date").isNotNull()))
    if derived.keys:
        name = f"tenderflow_{uuid.uuid4().hex}"
        spread = rows.repartition(BUCKETS, *derived.keys).write.mode("overwrite")
        spread = spread.bucketBy(BUCKETS, *derived.keys).sortBy(*derived.keys)
        spread.option("path", f"{folder}/rows").saveAsTable(name)
        reader.spark.sql(f"drop table {name}")  # the files stay
    else:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
    _one_file(note_files(source.drop("create_date"), listed), f"{folder}/files")


def _one_file(noted: DataFrame, path: str) -> None:
    noted.coalesce(1).write.mode("overwrite").parquet(path)  # a row for each file


def date_predicates(window: Window, date_literal: str = "DATE '{day}'") -> list[str]:
    """WHERE clauses that split a database read: one per business date of the window, and one
    each for what is before, after and without a date, so that every row is in exactly one."""
    days = (window.end - window.start).days + 1

    def literal(day) -> str:
        return date_literal.format(day=day)

    return [
        f"business_date < {literal(window.start)}",
        *[
            f"business_date = {literal(window.start + timedelta(days=n))}" for n in range(days)
        ],
        f"business_date > {literal(window.end)}",
        "business_date IS NULL",
    ]


#: a whole number of each undated table, by whose remainders its read can be split
SPLIT_KEYS = {
    "tnd_tndr": "LENGTH(tndr_id)",
    "tsn_session": "session_id",
    "tsn_session_wkstn": "session_id",
    "loc_rtl_loc": "rtl_loc_id",
    "crm_party": "party_id",
    "hrs_employee": "party_id",
    "cfg_profile_element_changes": "config_version",
    "dpl_deployment": "config_version",
    "loc_rtl_loc_collection_element": "LENGTH(org_scope_code)",
}


def residue_predicates(key: str, parts: int) -> list[str]:
    """WHERE clauses that split a database read by the remainder of a whole number, whose range
    need not be known.  A remainder has the number's sign, so each part has a negative one too;
    rows without the number are a part of their own."""
    remainder = f"MOD({key}, {parts})"
    return [
        f"{remainder} = 0",
        *[f"{remainder} IN ({i}, {i - parts})" for i in range(1, parts)],
        f"{key} IS NULL",
    ]


def read_predicates(
    name: str, window: Window | None, keys: Mapping[str, str], parts: int
) -> list[str] | None:
    """How the read of a table is split: by date if dated and a window is known, else by key."""
    if window is not None and name in DATED_TABLES:
        return date_predicates(window)
    key = keys.get(name, "trans_seq" if name in DATED_TABLES else None)
    return residue_predicates(key, parts) if key else None


def jdbc_reader(
    spark: SparkSession,
    url: str,
    options: Mapping[str, str],
    *,
    prefixes: Mapping[str, str] | None = None,
    window: Window | None = None,
    keys: Mapping[str, str] | None = None,
    parts: int = 32,
) -> Reader:
    """Read over JDBC with the caller's connection options; every row of a table is read.

    ``prefixes`` maps a table to the schema it lives in.  ``window``, the business dates most
    rows have, splits the reads of dated tables by date.  All others are split into ``parts`` by
    the remainder of a whole number: ``keys`` maps a table to an expression in the database's
    words, beside those of ``SPLIT_KEYS``.  Both only split: every row is in exactly one part.
    """
    known = {**SPLIT_KEYS, **(keys or {})}

    def read(name: str) -> DataFrame:
        prefix = (prefixes or {}).get(name)
        table = f"{prefix}.{name}" if prefix else name
        predicates = read_predicates(name, window, known, parts)
        return spark.read.jdbc(url, table, predicates=predicates, properties=dict(options))

    return read
