"""Near-duplicate vectors by p-stable hashing and exact cosines.

Vectors of one label are scaled to length one, so that cosine and Euclidean distance say the same.
In each of several tables a vector's bucket is a row of quantised projections on normal directions;
near vectors share a bucket in some table with the probability that ``expected_recall`` states.
All pairs of a bucket are compared in double precision, block by block: a bucket with more vectors
than a block holds is compared as pairs of blocks, each in a task of its own.  A pair found in
several tables counts in the first.  Comparing gives sums and a few links for each vector, never
the pairs.  Equal vectors are one vector with a number of copies.

Buckets are found by keys alone; a vector only goes to those it shares with others.  Whoever
compares vectors works out their keys in the earlier tables again: projections are sums of whole
numbers below 2**53, which are the same in whatever order they are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.components import components, local_roots
from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

LEAST_COSINE = 0.93
GRAIN = 1 << 20  # numbers are rounded to whole ones of this size before they are projected


@dataclass(frozen=True)
class Hashing:
    """``tables`` of ``projections`` each, quantised by ``width``; all follow from the seed."""

    tables: int = 24
    projections: int = 16
    width: float = 3.5
    seed: int = 7

    def drawn(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions and shifts for vectors of one size."""
        random = np.random.default_rng([self.seed, size])
        n = self.tables * self.projections
        return random.standard_normal((size, n)), random.uniform(0, self.width, n)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of unit vectors to their bucket in each table, as a 64-bit number."""
        directions, shifts = self.drawn(vectors.shape[1])
        whole = np.rint(vectors * GRAIN) @ np.rint(directions * GRAIN)
        whole += np.rint(shifts * GRAIN * GRAIN)
        cells = np.floor(whole / (self.width * GRAIN * GRAIN)).astype(np.int64)
        cells = cells.reshape(len(vectors), self.tables, self.projections).view(np.uint64)
        keys = np.zeros((len(vectors), self.tables), np.uint64)
        for i in range(self.projections):
            keys = (keys ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
        return keys.view(np.int64)

    def expected_recall(self, cosine: float) -> float:
        """The probability that two vectors of this cosine share a bucket."""
        ratio = self.width / math.sqrt(max(2 - 2 * cosine, 1e-12))
        outside = math.erfc(ratio / math.sqrt(2))
        near = 1 - outside - (1 - math.exp(-ratio**2 / 2)) * math.sqrt(2 / math.pi) / ratio
        return 1 - (1 - near**self.projections) ** self.tables


#: Vectors travel as bytes of these numbers, single if the column is single.
KINDS = {"array<float>": "<f4", "array<double>": "<f8"}
FILED = ["choice", "key", "label", "node"]


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one size, in double precision, scaled to length one."""
    vectors = np.array([np.frombuffer(row, kind) for row in rows], np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _reader(kind: str):
    """A function that puts a vector's bytes in its place, or null if it can't be compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for values in batch.column("embedding").to_pylist():
                usable = bool(values) and None not in values
                vector = np.array(values if usable else [], kind) + np.array(0, kind)  # no -0
                usable = vector.any() and np.isfinite(vector).all()
                vectors.append(vector.tobytes() if usable else None)
            columns = [batch.column(name) for name in ("row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(vectors, pa.binary())],
                names=["row", "vec_id", "label", "vector"],
            )

    return read


def _filer(hashing: Hashing, kind: str):
    """A function from (label, node, vector) to a row for each table, without the vector."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows = batch.column("vector").to_pylist()
                keys = np.zeros((len(rows), hashing.tables), np.int64)
                sizes = np.array([len(row) for row in rows])
                for size in np.unique(sizes).tolist():
                    of = np.flatnonzero(sizes == size)
                    keys[of] = hashing.keys(unit([rows[i] for i in of], kind)) ^ size
                for table in range(hashing.tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), table, np.int32)),
                            pa.array(np.ascontiguousarray(keys[:, table])),
                            batch.column("label"), batch.column("node"),
                        ],
                        names=FILED,
                    )

    return file


GROUP = ["choice", "label", "key", "low", "high"]


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that stand together and agree in ``names``."""
    held, at = [], None
    for batch in batches:
        start = 0
        for i, here in enumerate(zip(*[batch.column(n).to_pylist() for n in names], strict=True)):
            if here != at:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, start = [], here, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _comparer(least: float, kind: str, hashing: Hashing):
    """A function from filed rows, sorted by group, to what links each vector of a group."""

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = group.column("vector").to_pylist()
        sizes = np.array([len(row) for row in rows])
        for size in np.unique(sizes).tolist() if len(rows) > 1 else ():
            of = np.flatnonzero(sizes == size)
            part = group.take(of)
            vectors = unit([rows[i] for i in of], kind)
            linked = vectors @ vectors.T >= least
            np.fill_diagonal(linked, False)
            if part.column("low")[0] != part.column("high")[0]:  # only between both blocks
                block = part.column("block").to_numpy()
                linked &= block[:, None] != block
            some = linked.any(axis=1)
            if not some.any():
                continue
            first = linked.copy()
            earlier = part.column("choice")[0].as_py()
            if earlier:
                at = np.flatnonzero(some)
                keys, among = hashing.keys(vectors[at]), np.ix_(at, at)
                for table in range(earlier):
                    first[among] &= keys[:, table][:, None] != keys[:, table]
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[some]), pa.array((first @ copies)[some]),
                    pa.array(node[local_roots(linked)][some]),
                ],
                names=["node", "n", "root"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, GROUP):
            yield from compare(group)

    return run


def _in_blocks(nodes: DataFrame, filed: DataFrame, block: int) -> DataFrame:
    """The vectors of ``nodes`` in each bucket they share with others, with the pairs of blocks,
    low and high, that they are compared in."""
    where = ["choice", "label", "key"]
    shared = stage(
        filed.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
        .select(*where, F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "shared",
    )
    dealt = filed.join(shared, where).join(nodes.select("node", "copies", "vector"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        dealt.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("blocks", "other")
    )


def vector_groups(
    vectors: DataFrame, least: float = LEAST_COSINE, hashing: Hashing = Hashing(),
    block: int = 1024,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id,
    kept.

    Two rows are linked if their labels are equal and not null and their cosine is found to be at
    least ``least``; vectors of different sizes are not compared.  ``n_links`` counts other rows,
    equal ones too; ``component_id`` is the smallest vec_id reachable; ``kept`` says that it is
    the row's own.  Null, empty and zero vectors and those with null or non-finite numbers are
    linked with nothing.  No rows give no rows; other columns are not read.
    """
    ship_code(vectors.sparkSession)
    kind = KINDS[dict(vectors.dtypes)["embedding"]]
    label = vectors["label"].cast("string").alias("label")
    number = F.monotonically_increasing_id().alias("row")
    read = stage(
        vectors.select(number, vectors["vec_id"].cast("long"), label, "embedding")
        .mapInArrow(_reader(kind), "row long, vec_id long, label string, vector binary"),
        "read",
    )
    comparable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    nodes = stage(
        read.where(comparable).groupBy("label", "vector")
        .agg(F.min("row").alias("node"), F.count("*").alias("copies")),
        "nodes",
    )
    filed = nodes.select("label", "node", "vector").mapInArrow(
        _filer(hashing, kind), "choice int, key long, label string, node long"
    )
    found = stage(
        _in_blocks(nodes, filed, block).repartition(*GROUP).sortWithinPartitions(*GROUP)
        .mapInArrow(_comparer(least, kind, hashing), "node long, n long, root long"),
        "found",
    )
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = stage(
        nodes.join(links, "node", "left").join(components(edges), "node", "left").select(
            "label", "vector", F.coalesce("root", "node").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "known",
    )
    rooted = stage(
        read.where(comparable).join(known, ["label", "vector"])
        .select("vec_id", "n_links", "root"),
        "rooted",
    )
    smallest = stage(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
    alone = read.where(~comparable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        rooted.join(smallest, "root").select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
