"""Sources mixed to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued twice, as a document may be taken twice.
A queued document's virtual finish time is the words of its source up to and with it, divided by
the source's target.  All queues are sorted together by finish time and cut where the total budget
is spent.  Running sums have two levels, sums of slices and sums within a slice, so neither a large
source nor the whole order is ever one task's work.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderflow.llm import rows
from tenderflow.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2  # times a document may be taken
SLICE_DIGITS = 3  # hex digits of the shuffle hash: 4,096 slices of a source
TIME_SLICES = 4096  # per unit of virtual time


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A hash of a document that orders it within its source, the same on each run."""
    nothing = F.lit("")
    return F.md5(F.concat(
        F.lit(seed), F.coalesce(doc_id.cast("string"), nothing), F.lit("|"),
        F.coalesce(text, nothing),
    ).cast("binary"))


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
    most: int = MOST,
) -> DataFrame:
    """source, source_rank, source_size, target: one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget`` times all
    sizes; a target stops at ``most`` times its source, and what is over goes to the others by
    weight.  With sources ordered by cap / weight the full ones come first, so one pass finds the
    level all others share.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(everything))
        .withColumn("weight", F.element_at(cycle, (F.col("source_rank") - 1) % len(weights) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("pot", F.lit(budget) * F.sum("source_size").over(whole))
        .withColumn("before", F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn(
            "level",
            (F.col("pot") - F.coalesce("before", F.lit(0))) / F.sum("weight").over(after),
        )
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn(
            "first",
            F.min(F.when(
                F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level")
            )).over(whole),
        )
        .select(
            "source", "source_rank", "source_size", "pot",
            F.when(
                F.col("place") >= F.col("first.place"), F.col("weight") * F.col("first.level")
            ).otherwise(F.col("cap").cast("double")).alias("target"),
        )
    )


def _running(df: DataFrame, group: list[str], slice_: str, order: list[str], of: str) -> DataFrame:
    """``df`` with ``total``: the sum of ``of`` over its group up to and with each row."""
    within = W.partitionBy(*group, slice_).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*group, slice_).agg(F.sum(of).alias("slice_sum"))
    starts = sums.select(
        *group, slice_, F.coalesce(F.sum("slice_sum").over(before), F.lit(0)).alias("start")
    )
    return (
        df.withColumn("within", F.sum(of).over(within)).join(starts, [*group, slice_])
        .withColumn("total", F.col("start") + F.col("within")).drop("start", "within")
    )


def queue(sized: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """Every document of ``sized`` (doc_id, source, size, shuffle) ``most`` times over, with
    its finish time, ``position`` (words taken in global order up to and with it) and ``taken``.

    Ties in time go by source, round, shuffle hash and doc_id.  A source without words has no
    finish times and nothing is taken of it.
    """
    mine = sized.alias("d").join(
        aims.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
    ).select("d.*", "s.source_rank", "s.source_size", "s.pot", "s.target")
    mine = mine.withColumn("slice", F.substring("shuffle", 1, SLICE_DIGITS))
    placed = _running(mine, ["source_rank"], "slice", ["shuffle", "doc_id"], "size").drop("slice")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    finish = (F.col("round") * F.col("source_size") + F.col("total")) / F.col("target")
    late = 2 * TIME_SLICES + F.floor(F.log2("finish") * 64)
    timed = (
        placed.withColumn("round", rounds)
        .withColumn("finish", F.when(F.col("target") > 0, finish))
        .drop("total")
        .withColumn(
            "span",
            F.when(F.col("finish") < 2, F.floor(F.col("finish") * TIME_SLICES)).otherwise(late),
        )
    )
    order = ["finish", "source_rank", "round", "shuffle", "doc_id"]
    queued = _running(timed.where("finish is not null"), [], "span", order, "size")
    queued = queued.withColumnRenamed("total", "position")
    out = queued.unionByName(timed.where("finish is null"), allowMissingColumns=True)
    taken = F.coalesce(F.col("position") <= F.col("pot"), F.lit(False))
    return out.withColumn("taken", taken).drop("span")


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("number"), row.alias("row"), "doc_id",
            "source", words(docs["text"]).alias("size"),
            shuffle_key(docs["doc_id"], docs["text"]).alias("shuffle"),
        ),
        "sized",
    )


def mix_counts(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, taken, copies.

    Null text has size 0, and a text of any length is counted whole; null is a source of its own;
    repeated rows queue one after the other.
    No rows give no rows.  Other columns of ``docs`` are not read, but for ``row``, by which the
    rows can be told apart; else it is 0.
    """
    sized = _sized(docs, F.lit(0) if row is None else row)
    queued = queue(sized, stage(targets(sized), "targets"))
    copies = F.sum(F.col("taken").cast("long"))
    return (
        queued.groupBy("number", "row", "doc_id", "source", "size", "source_size", "target")
        .agg(copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("number")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with all its columns."""
    return rows.repeat(docs, mix_counts(docs, rows.row_hash(docs)))
