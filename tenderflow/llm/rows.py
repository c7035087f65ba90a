"""Decisions about rows, taken back to the rows.

A row is known by its doc_id and a hash of all its columns, so its text need not be stored or
numbered to be found again.  Rows that are the same throughout can stand for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.sources.staging import stage

DOC, ROW = "__doc", "__row"


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; which of them are null counts too."""
    columns = [docs[name] for name in docs.columns]
    return F.xxhash64(*columns, *[column.isNull() for column in columns])


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({DOC: docs["doc_id"], ROW: row_hash(docs)})


def _same(docs: DataFrame, decided: DataFrame) -> Column:
    return docs[DOC].eqNullSafe(decided["doc_id"]) & (docs[ROW] == decided["row"])


def keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decided`` (doc_id, row, kept) drops.

    Of rows that are the same throughout one stays, if any is kept.
    """
    sums = stage(
        decided.groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.max("kept").alias("kept")),
        "decided",
    )
    marked = _marked(docs)
    lost = stage(sums.where(~F.col("kept")).select("doc_id", "row"), "lost")
    left = marked.join(lost, _same(marked, lost), "left_anti")
    return _once(left, sums.where("kept and n > 1")).drop(DOC, ROW)


def repeat(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``counted`` (doc_id, row, copies) says in sum."""
    sums = stage(
        counted.groupBy("doc_id", "row")
        .agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies"))
        .where("copies > 0"),
        "counted",
    )
    marked = _once(_marked(docs), sums.where("n > 1"))
    wanted = sums.select("doc_id", "row", F.col("copies").alias("__copies"))
    taken = marked.join(wanted.withColumnsRenamed({"doc_id": "__its", "row": "__of"}),
                        F.col(DOC).eqNullSafe(F.col("__its")) & (F.col(ROW) == F.col("__of")))
    each = F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")
    return taken.select(*docs.columns, each).drop("__copy")


def _once(marked: DataFrame, several: DataFrame) -> DataFrame:
    """Rows that stand several times throughout, once."""
    several = stage(several.select("doc_id", "row"), "several")
    if several.isEmpty():
        return marked
    one = marked.join(several, _same(marked, several), "left_semi").dropDuplicates([DOC, ROW])
    return marked.join(several, _same(marked, several), "left_anti").unionByName(one)
