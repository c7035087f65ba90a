"""Exact duplicates through an extendible-hash index on shared files.

A text's key is a 64-bit hash.  A directory maps the leading bits of a key to a bucket; it starts
as deep as an even spread needs, and a bucket with too many entries is split by doubling: one more
bit for its keys.  Copies of one text share a key, which no bit can split, so a key with more
entries than a bucket holds gets overflow pages.  The index files of a bucket lie in one folder of
the shared staging area; an entry has its text only if another entry has the same key.  Owner
tasks read the buckets, each a range of keys, and chain the entries of a key by their bytes.

Only DataFrame functions are used.  Copies meet as partial sums, never as rows in one task.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.llm import rows
from tenderflow.sources.staging import stage, staging_folder

BUCKET_ENTRIES = 1 << 16


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def text_key(text: Column) -> Column:
    """Equal for equal normalised texts.  ``lower`` is coarser than A-Z alone, and much faster;
    texts that only differ in the case of other letters meet in a chain and part there."""
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def place_keys(keys: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Give each key (``h``, with its number of entries ``n``) a bucket and the bucket's pages.

    A bucket's number is its prefix below a leading one, so its depth shows.  Keys with more
    entries than ``capacity`` don't count towards splitting; their entries fill pages.
    """
    light = F.when(F.col("n") <= capacity, F.col("n")).otherwise(0)
    total = keys.agg(F.sum(light)).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, 2 * total / capacity))))
    placed, waiting = [], keys
    while True:
        marked = waiting.withColumn("prefix", _prefix(depth))
        load = stage(
            marked.groupBy("prefix").agg(
                F.sum(light).alias("light"), F.count("*").alias("keys"),
                F.sum("n").alias("entries"),
            ),
            f"directory-{depth}",
        )
        splits = (F.col("light") > capacity) & (F.col("keys") > 1) & F.lit(depth < 63)
        kept = load.where(~splits).select(
            "prefix",
            (F.col("prefix") + F.lit(1 << min(depth, 62))).alias("bucket"),
            F.ceil(F.col("entries") / capacity).cast("int").alias("pages"),
        )
        placed.append(marked.join(kept, "prefix").select("h", "n", "bucket", "pages"))
        full = load.where(splits)
        if full.isEmpty():
            return reduce(DataFrame.unionByName, placed)
        waiting = marked.join(full, "prefix", "left_semi").select("h", "n")
        depth += 1


def build_index(
    docs: DataFrame, capacity: int = BUCKET_ENTRIES,
    key: Callable[[Column], Column] = text_key, row: Column | None = None,
) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) and read it back.

    One entry per row: bucket, h, row (``row``, or a number of this index's own), doc_id,
    text_sha256, chained (another entry has this key) and body, the normalised text of chained
    entries.
    """
    spark = docs.sparkSession
    keys = stage(
        docs.select(key(F.col("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")),
        "keys",
    )
    entries = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id",
        key(F.col("text")).alias("h"), normalised(F.col("text")).alias("body"),
    ).withColumn("text_sha256", F.sha2("body", 256))
    chained = F.col("n") > 1
    filed = (
        entries.join(place_keys(keys, capacity), "h")
        .select(
            "bucket", "pages", "h", "row", "doc_id", "text_sha256", chained.alias("chained"),
            F.when(chained, F.col("body")).alias("body"),
        )
        .withColumn("page", F.pmod("row", "pages"))
        .repartition("bucket", "page")
        .drop("pages", "page")
    )
    path = staging_folder(spark, "index")
    filed.write.partitionBy("bucket").parquet(path)
    columns = [f for f in filed.schema.fields if f.name != "bucket"]
    schema = filed.select(*[f.name for f in columns], "bucket").schema
    return spark.read.schema(schema).parquet(path)


def exact_groups(
    docs: DataFrame, capacity: int = BUCKET_ENTRIES,
    key: Callable[[Column], Column] = text_key, row: Column | None = None,
) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text is empty text.  Of equal
    texts the largest doc_id stays; of rows that share that doc_id too, exactly one is kept, and
    null doc_ids stay only where there is no other.  Texts are compared whole, however long.  No
    rows give no rows.  Other columns of ``docs`` are not read.
    """
    index = build_index(docs, capacity, key, row)
    single = index.where(~F.col("chained")).select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    # owner tasks: grouping by key and body compares the bytes of a chain
    best = F.max(F.struct("doc_id", "row"))
    classes = (
        index.where("chained").groupBy("bucket", "h", "body")
        .agg(
            best.alias("best"), F.count("*").alias("group_size"),
            F.min("text_sha256").alias("text_sha256"),
        )
        .groupBy("bucket", "h", "text_sha256")
        .agg(
            F.max("best").alias("best"), F.max("group_size").alias("group_size"),
            F.count("*").alias("bodies"),
        )
        .withColumn(
            "group_size",
            F.when(F.col("bodies") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts share a key and a SHA-256")).cast("long")),
        )
    )
    classes = stage(classes, "classes")  # so that Spark sees its size, and splits a hot text
    named = (
        index.where("chained").select("bucket", "h", "text_sha256", "doc_id", "row")
        .join(classes, ["bucket", "h", "text_sha256"])
        .select(
            "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
            (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256",
        )
    )
    return single.unionByName(named)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops, with all their columns."""
    return rows.keep(docs, exact_groups(docs, row=rows.row_hash(docs)))
