"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonhole blocks.

Fingerprints that differ in few bits agree in most of their blocks, so each is filed under every
choice of enough blocks, and only fingerprints filed together are compared.  Equal fingerprints are
one from the start.  A group too large to compare is not: its members are filed anew under more and
smaller blocks, which are longer in sum, so that in the end a group can't have more members than
the bits outside its key can tell apart.  That is exact at each level: a pair either shares a group
that is compared, or both have moved on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm import rows
from tenderflow.llm.components import components, local_roots
from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

SHINGLE = 3
BITS = 2
SEED = 42
LEVELS = (4, 8, 16)  # blocks of a fingerprint
COMPARED = 512  # most members of a group that is compared before the last level
SLICE_BYTES = 1 << 20

LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def word_slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with A-Z lower-cased, in lists of bounded size.

    ``bytes.split`` parts at exactly the six white-space bytes of ASCII.
    """
    data = text.encode().lower()
    start = 0
    while len(data) - start > SLICE_BYTES:
        end = start + SLICE_BYTES
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits: each is set if it is in more than half of the shingles' XXH64 values.

    Repeated shingles count as often as they occur.  A text of fewer words is one shingle, and
    one without words, like null, has no bit set.
    """
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in word_slices(text or ""):
        words = last + words
        shingles = [b" ".join(s) for s in zip(*[words[i:] for i in range(size)], strict=False)]
        last = words[max(0, len(words) - size + 1):]
        ones += _ones(shingles)
        n += len(shingles)
    if not n and last:
        ones, n = _ones([b" ".join(last)]), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _ones(shingles: list[bytes]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(size: int):
    @F.pandas_udf(T.LongType())
    def of(texts):
        return texts.map(lambda text: fingerprint(text, size)).astype("int64")

    return of


def linked_fingerprints(
    prints: DataFrame, bits: int = BITS, levels: tuple[int, ...] = LEVELS,
    compared: int = COMPARED,
) -> DataFrame:
    """Links (a, b) that connect the distinct ``prints`` (print) at most ``bits`` bits apart.

    Each compared group gives a star for each of its local components, not all its pairs.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column("prints"):
                members = np.sort(np.array(group.values, np.int64))
                near = np.bitwise_count((members[:, None] ^ members).view(np.uint64)) <= bits
                roots = local_roots(near)
                own = roots != np.arange(len(roots))
                a.append(members[roots[own]])
                b.append(members[own])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
                )

    ship_code(prints.sparkSession)
    links = None
    for blocks in levels:
        width = 64 // blocks
        masks = [
            sum(((1 << width) - 1) << (width * i) for i in chosen)
            for chosen in combinations(range(blocks), blocks - bits)
        ]
        signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
        filed = prints.select(
            "print",
            F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in signed]))
            .alias("choice", "key"),
        )
        sizes = stage(
            filed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes"
        )
        last = blocks == levels[-1]
        fit = sizes if last else sizes.where(F.col("n") <= compared)
        groups = (
            filed.join(fit, ["choice", "key"]).groupBy("choice", "key")
            .agg(F.collect_list("print").alias("prints"))
        )
        found = groups.select("prints").mapInArrow(verify, LINKS)
        links = found if links is None else links.union(found)
        large = sizes.where(F.col("n") > compared)
        if last or large.isEmpty():
            return links
        moved = filed.join(large, ["choice", "key"], "left_semi")
        prints = stage(moved.select("print").distinct(), "prints")


def _printed(docs: DataFrame, size: int, row: Column) -> DataFrame:
    ship_code(docs.sparkSession)
    printed = fingerprints(size)(docs["text"]).alias("print")
    return stage(docs.select(row.alias("row"), "doc_id", printed), "printed")


def near_groups(printed: DataFrame, bits: int = BITS) -> DataFrame:
    """(print, component_id, first): each distinct fingerprint of ``printed`` (row, doc_id,
    print), the smallest doc_id of its component, and the number of the row to keep."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = stage(printed.groupBy("print").agg(best.alias("best")), "distinct")
    roots = components(linked_fingerprints(distinct.select("print"), bits))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "best", F.coalesce("root", "print").alias("root")
    )
    rooted = stage(rooted, "rooted")
    firsts = stage(rooted.groupBy("root").agg(F.min("best").alias("best")), "firsts")
    return stage(
        rooted.select("print", "root").join(firsts, "root").select(
            "print", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first")
        ),
        "groups",
    )


def simhash_groups(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id reachable over fingerprints at most ``bits`` bits apart.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts are read
    whole, however long.  Null doc_ids name a component only if it has no other.  Repeated rows each give a row; no rows give none;
    other columns are not read.
    """
    printed = _printed(docs, size, F.monotonically_increasing_id())
    return printed.join(near_groups(printed, bits), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component of :func:`simhash_groups`: that with the smallest
    doc_id, one of them if rows share it.  All columns stay."""
    printed = _printed(docs, size, rows.row_hash(docs))
    groups = near_groups(printed, bits).select("print", "component_id", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("first"))
    return rows.keep(docs, printed.join(groups, "print").withColumn("kept", kept))
