"""URL rules by a cascade of Bloom filters.

All keys a corpus can be asked about are known: its hosts with their parent domains, of as many
labels as rules have, joined with the path prefixes of the lengths that rules have.  The first filter of a cascade holds the listed
keys, the next those other keys of the corpus that pass it by mistake, the next those listed keys
that pass that one, and so on until none pass by mistake.  The first filter that a key fails then
says whether it is listed, exactly for every key of the corpus, and rows are judged without a join.
Hashes differ from level to level.  Filters are sent to the tasks only below a checked size; longer
lists are joined instead.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BITS_PER_KEY = 12
HASHES = 4
MOST_BYTES = 64 << 20  # of all filters of one list
LEVELS = 32  # each has about a hundredth of the keys of the one but last
ACTIONS = ("block", "allow")


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def keys(lengths: list[int], labels: int) -> Column:
    """The rules that could fit a row's ``host`` and ``path``, longest first: rules have paths of
    these ``lengths`` and hosts of at most so many ``labels``."""
    own = F.substring_index("host", ".", -labels)
    parts = F.split(own, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths
    ]))
    made = F.flatten(F.transform(
        domains, lambda domain: F.transform(prefixes, lambda p: F.concat(domain, p))
    ))
    long_first = F.array_sort(F.transform(
        made, lambda key: F.struct((-F.length(key)).alias("n"), key.alias("key"))
    ))
    return F.transform(long_first, lambda one: one["key"])


def level_hash(name: str, level: int, key: Column) -> Column:
    return F.xxhash64(F.lit(f"{name}-{level}"), key)


def _hashes(name: str, level: int, of: Column) -> Column:
    return F.transform(of, lambda key: level_hash(name, level, key))


def _passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter holds; both halves of a hash give its places."""
    both = hashes.astype(np.int64).view(np.uint64)
    first, step = both & np.uint64(0xFFFFFFFF), (both >> np.uint64(32)) | np.uint64(1)
    passes = np.ones(len(both), bool)
    for i in range(HASHES):
        place = (first + np.uint64(i) * step) & np.uint64(64 * len(words) - 1)
        bit = np.uint64(1) << (place & np.uint64(63))
        passes &= (words[(place >> np.uint64(6)).astype(np.int64)] & bit) != 0
    return passes


def _filter_of(members: DataFrame, name: str, level: int, size: int) -> np.ndarray:
    """The same filter made by Spark, which ORs the bits of each word of ``size`` bits."""
    first = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    step = F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.array(*[
        (first + F.lit(i) * step).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)
    ])
    found = (
        members.select(level_hash(name, level, F.col("key")).alias("h"))
        .select(F.explode(places).alias("place"))
        .select(
            F.shiftright("place", 6).alias("word"),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
        )
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    words = np.zeros(size // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


@dataclass(frozen=True)
class Cascade:
    """Filters by level, as 64-bit words; the first, third and so on hold listed keys."""

    name: str
    filters: list[np.ndarray]

    def hashes(self, of: Column) -> list[Column]:
        """For an array of keys, the array of their hashes at each level."""
        return [_hashes(self.name, level, of) for level in range(len(self.filters))]

    def contains(self, n: int, hashes: list[np.ndarray]) -> np.ndarray:
        """For each of ``n`` keys, by its hash at each level, whether it is listed."""
        listed, at = np.zeros(n, bool), np.arange(n)
        for level, (words, of) in enumerate(zip(self.filters, hashes, strict=True)):
            passes = _passes(words, of[at])
            listed[at[~passes]] = level % 2 == 1
            at = at[passes]
        listed[at] = len(self.filters) % 2 == 1
        return listed


def _tester(words: np.ndarray):
    @F.pandas_udf(T.BooleanType())
    def passes(hashes: pd.Series) -> pd.Series:
        return pd.Series(_passes(words, hashes.to_numpy()))

    return passes


def build_cascade(
    name: str, listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES
) -> Cascade | None:
    """The cascade of the ``listed`` keys (key) within ``universe`` (key, distinct), or None if
    its filters would take more than ``most_bytes``."""
    ship_code(universe.sparkSession)
    members = stage(universe.join(listed, "key", "left_semi"), "listed")
    others = stage(universe.join(listed, "key", "left_anti"), "others")
    filters: list[np.ndarray] = []
    while not members.isEmpty():
        if len(filters) == LEVELS:
            raise RuntimeError("keys can't be told apart")
        size = 1 << max(10, (members.count() * BITS_PER_KEY - 1).bit_length())
        if sum(words.nbytes for words in filters) + size // 8 > most_bytes:
            return None
        words = _filter_of(members, name, len(filters), size)
        passes = _tester(words)
        hashed = level_hash(name, len(filters), F.col("key"))
        filters.append(words)
        members, others = stage(others.where(passes(hashed)), "passing"), members
    return Cascade(name, filters)


def _finder(cascades: list[Cascade], columns: list[str], default: str):
    """A function from rows with their keys and each cascade's hashes of these, beside
    ``columns``, to ``columns`` with the rule and verdict of the first key that is listed."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys_, *hashes = [
                column.combine_chunks() for column in table.columns[len(columns):]
            ]
            ends = np.cumsum(keys_.value_lengths().to_numpy(zero_copy_only=False))
            flat = keys_.flatten()
            which, at = np.full(len(flat), -1), 0
            for number, cascade in enumerate(cascades):
                until = at + len(cascade.filters)
                own = [one.flatten().to_numpy() for one in hashes[at:until]]
                which[cascade.contains(len(flat), own)] = number
                at = until
            hits = np.flatnonzero(which >= 0)
            rows, first = np.unique(np.searchsorted(ends, hits, side="right"), return_index=True)
            rules = np.full(batch.num_rows, -1)
            rules[rows] = hits[first]
            known = pa.array(rules, mask=rules < 0)
            names = pa.array([cascade.name for cascade in cascades])
            verdicts = names.take(pa.array(np.maximum(which, 0))).take(known)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], flat.take(known), verdicts.fill_null(default)],
                names=[*columns, "rule", "verdict"],
            )

    return find


def judge(
    urls: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``urls`` (url, other columns) with host, path, rule and verdict.

    ``rules`` (host, path, action) fit their host and its subdomains where the url's path starts
    with the rule's; the longest wins, block before allow if a rule is in both lists.  ``rule`` is
    its host and path, null if none fits, and then the verdict is ``default``.  A null url or one
    without ``://`` has an empty host and path.  A long host or path has no more keys than a short
    one.  Repeated rows each give a row; no rules fit
    nothing; columns named like the results are replaced.
    """
    sizes = rules.select(F.length("path").alias("n")).where("n is not null").distinct().collect()
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    listed = rules.select(F.concat("host", "path").alias("key"), "action")
    split = urls.withColumns({"host": host(urls["url"]), "path": path(urls["url"])})
    ours = keys([row.n for row in sizes] or [0], max(1, labels or 1))
    universe = stage(
        split.select("host", "path").distinct().select(F.explode(ours).alias("key")).distinct(),
        "universe",
    )
    cascades = [
        build_cascade(
            action, listed.where(F.col("action") == action).select("key").distinct(), universe,
            most_bytes,
        )
        for action in ACTIONS
    ]
    split = split.drop("rule", "verdict")
    if None in cascades:
        return _joined(split, listed, ours, default)
    cascades.reverse()  # a later list overrides
    hashes = [column for cascade in cascades for column in cascade.hashes(ours)]
    made = [column.alias(f"__{i}") for i, column in enumerate([ours, *hashes])]
    schema = T.StructType([
        *split.schema.fields, T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ])
    return split.select(*split.columns, *made).mapInArrow(
        _finder(cascades, split.columns, default), schema
    )


def _joined(split: DataFrame, listed: DataFrame, ours: Column, default: str) -> DataFrame:
    """The same by a join, for lists too long to send."""
    first = F.min(F.struct(
        F.col("n"), F.when(F.col("action") == ACTIONS[0], 0).otherwise(1).alias("o"), "key",
        "action",
    ))
    parts = split.select("host", "path").distinct()
    best = (
        parts.select("host", "path", F.posexplode(ours).alias("n", "key"))
        .join(listed, "key").groupBy("host", "path").agg(first.alias("__best"))
    )
    judged = split.join(best, ["host", "path"], "left")
    return judged.withColumns({
        "rule": F.col("__best.key"),
        "verdict": F.coalesce("__best.action", F.lit(default)),
    }).drop("__best").select(*split.columns, "rule", "verdict")
