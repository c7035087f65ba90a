"""A Merkle manifest of a dataset, with a proof for every row.

Rows are leaves of a tree for their group, in order; runs of ``FAN`` neighbours hash to a node of
the next level until one is left, and the groups' roots are the leaves of one more such tree.
Proofs come by pointer jumping: each node holds the segment of siblings on its way to an ancestor,
first its parent.  A join of the nodes with themselves appends an ancestor's own segment, so the
distance doubles each time, and only nodes at multiples of it are needed further.  A proof takes
the logarithm of its length in joins.

Positions are found by a range sort and the counts of its partitions, so a group may be larger than
any task.  A run has ``FAN`` members, so nothing is gathered that grows.  Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderflow.sources.staging import stage

FAN = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"


def digest(text: Column) -> Column:
    """Lower-case hex of the SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of values read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(F.concat(*[field(value) for value in values]))


def _hexes(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: F.lower(F.hex(m["digest"]))), "")


def proof_hash(path: Column) -> Column:
    """The hash of all siblings of a path, level by level and from left to right."""
    each = F.transform(path, lambda s: F.lower(F.concat(F.hex(s["before"]), F.hex(s["after"]))))
    return digest(F.array_join(each, ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by its path."""
    def up(below: Column, step: Column) -> Column:
        return digest(F.concat(
            F.lower(F.hex(step["before"])), below, F.lower(F.hex(step["after"]))
        ))

    return F.aggregate(path, leaf, up)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their group from 0, and ``n``, the group's size.

    Rows that agree in ``order`` are told apart by a number of their own.  Sorted partitions hold
    places as numbers; what a group has in earlier partitions is added from their counts.
    """
    keys = [*group, *order, "_tie"]
    placed = stage(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        f"{name}-sorted",
    )
    counts = placed.groupBy("_part", *group).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_here")
    )
    whole = W.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(
        counts.select(
            F.col("_part").alias("_its"), *[F.col(c).alias(f"_of_{c}") for c in group], "_first",
            F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_here").over(whole).alias("n"),
        ),
        f"{name}-starts",
    )
    same = F.col("_part") == F.col("_its")
    for column in group:
        same &= F.col(column).eqNullSafe(F.col(f"_of_{column}"))
    return placed.join(starts, same).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias("pos"), "n"
    )


class Trees:
    """Trees over nodes (tree, pos, n, digest, other columns): their levels and their roots.

    ``levels`` has a table of paths for each level below the roots; ``roots`` is (tree, digest).
    """

    def __init__(self, nodes: DataFrame, name: str):
        self.name, self.levels = name, []
        extra = [c for c in nodes.columns if c not in ("tree", "pos", "n", "digest")]
        largest = nodes.agg(F.max("n")).first()[0] or 0
        roots = nodes.where("n = 1").select("tree", "digest", *extra)
        self.single = roots.select("tree", F.lit(0).cast("long").alias("pos"), "digest", *extra)
        self.roots = roots.select("tree", "digest")
        while largest > 1:
            runs = stage(
                nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("run"))
                .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *extra))).alias("m")),
                f"{name}-runs",
            )
            self.levels.append(self._members(runs, extra))
            nodes = runs.select(
                "tree", F.col("run").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
                F.unhex(digest(_hexes(F.col("m")))).alias("digest"),
            )
            self.roots = self.roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
            extra, largest = [], -(-largest // FAN)

    @staticmethod
    def _members(runs: DataFrame, extra: list[str]) -> DataFrame:
        """Each node of a level with the siblings of its run."""
        m, i = F.col("m"), F.col("i")
        step = F.struct(
            F.unhex(_hexes(F.slice(m, F.lit(1), i))).alias("before"),
            F.unhex(_hexes(F.slice(m, i + 2, F.lit(FAN)))).alias("after"),
        )
        return runs.select("tree", "m", F.posexplode("m").alias("i", "one")).select(
            "tree", "one.pos", "one.digest", *[f"one.{c}" for c in extra],
            F.array(step).cast(PATH).alias("path"),
        )

    def leaves(self) -> DataFrame:
        """All leaves (tree, pos, digest, other columns) with their paths to their tree's root."""
        levels, reach = self.levels, 1
        while len(levels) > 1:
            pairs = [levels[at:at + 2] for at in range(0, len(levels), 2)]
            levels = [self._jump(*pair, reach) if len(pair) == 2 else pair[0] for pair in pairs]
            # the leaves themselves wait for the last job
            levels[1:] = [stage(one, f"{self.name}-reach-{2 * reach}") for one in levels[1:]]
            reach *= 2
        alone = self.single.withColumn("path", F.array().cast(PATH))
        return levels[0].unionByName(alone) if levels else alone

    @staticmethod
    def _jump(near: DataFrame, far: DataFrame, reach: int) -> DataFrame:
        """``near`` nodes with the segment of their ancestor ``reach`` levels up appended."""
        ancestor = far.select(
            F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path")
        )
        here = (F.col("tree") == F.col("_tree")) & (
            F.expr(f"pos div {FAN ** reach}L") == F.col("_pos")
        )
        longer = F.concat("path", F.coalesce("_path", F.array().cast(PATH)))
        return near.join(ancestor, here, "left").withColumn("path", longer).select(*near.columns)


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, claimed,
    subroot, root, path.

    ``leaf`` hashes the five columns, null told from empty.  Each source, null among them, is a
    tree of its rows by doc_id (nulls first; rows with one doc_id by leaf); the sources' roots are
    a tree in the order of their names' bytes, null first.  ``path`` has the siblings of each run
    up to the root, which :func:`fold` and :func:`proof_hash` read.  ``claimed`` is a leaf hash
    that somebody else states for the row; it is only carried along, and null if not given.

    A lone row is its source's root, and a lone source's root is the root.  Repeated rows are
    leaves of their own.  Texts of any length are hashed whole.  No rows give no rows; other
    columns are not read.
    """
    values = [docs[name] for name in LEAF_COLUMNS]
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    hashed = docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        F.unhex(leaf_hash(*values)).alias("digest"), F.unhex(claimed).alias("claimed"),
    )
    placed = stage(numbered(hashed, ["source"], ["doc_id", "digest"], "leaves"), "leaves")
    names = stage(
        numbered(placed.select("source").distinct(), [], ["source"], "sources"), "sources"
    )
    tree = names.select(F.col("source").alias("_source"), F.col("pos").alias("tree"))
    nodes = placed.join(tree, F.col("source").eqNullSafe(F.col("_source")))
    trees = Trees(nodes.drop("source", "_source"), "tree")

    count = names.count()
    subroots = stage(trees.roots, "subroots")
    top = Trees(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
            F.lit(count).cast("long").alias("n"), "digest",
        ),
        "top",
    )
    highest = top.roots.first()
    above = top.leaves().select(
        F.col("pos").alias("_top"), F.col("digest").alias("subroot"), F.col("path").alias("_above")
    )
    return trees.leaves().join(stage(above, "above"), F.col("tree") == F.col("_top")).select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("claimed")).alias("claimed"), F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(highest and highest.digest.hex()).cast("string").alias("root"),
        F.concat("path", "_above").alias("path"),
    )


def verified(proven: DataFrame) -> DataFrame:
    """:func:`manifest`'s rows with proof_sha256, folded_root (of the claimed leaf, or else the
    leaf) and whether that is the root, in place of the path."""
    told = F.coalesce("claimed", "leaf")
    return proven.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        fold(told, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(docs: DataFrame) -> Column:
    """For every second document by the CRC-32 of its doc_id: its leaf hash without line feeds in
    its text; null for the others and for a null doc_id."""
    half = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    *others, text = [docs[name] for name in LEAF_COLUMNS]
    return F.when(half, leaf_hash(*others, F.replace(text, F.lit("\n"), F.lit(""))))
