"""Sum of what an amount exceeds, over all smaller values of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: width of one value band; a band of one key is one group of the running sums
BAND = 64


def surplus_over(
    lines: DataFrame, values: DataFrame, key: list[str], amount: str, value: str, out: str
) -> DataFrame:
    """Add ``out`` = sum of (amount - value) over the key's values below the amount.

    NULL where no value is below.  The same as a join of ``lines`` to ``values`` on the key
    with a positive difference, summed per line, but no pair is formed: with n smaller values
    that add up to s, the sum is n * amount - s.  Both are running totals over the different
    values of a key, taken within bands of values, plus the totals of the bands below.  So a
    key with very many rows is first reduced to its different values and then split by band.
    """
    point = F.col("_point")
    stored = (
        values.filter(F.col(value).isNotNull())
        .groupBy(*key, F.col(value).alias("_point"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_side", F.lit(1))
    )
    asked = (
        lines.filter(F.col(amount).isNotNull())
        .select(*key, F.col(amount).alias("_point"), F.lit(0).cast("bigint").alias("_n"))
        .distinct()
        .withColumn("_side", F.lit(0))
    )
    points = asked.unionByName(stored).select(
        *key, "_point", "_side", "_n",
        (point * F.col("_n")).cast("decimal(38,6)").alias("_s"),
        F.floor(point / BAND).cast("bigint").alias("_band"),
    )
    # an asked amount sorts before an equal stored value, which is not below it
    upto = W.partitionBy(*key, "_band").orderBy("_point", "_side").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    inside = points.select(
        *key, "_band", "_point", "_side",
        F.sum("_n").over(upto).alias("_n"), F.sum("_s").over(upto).alias("_s"),
    ).filter(F.col("_side") == 0)
    lower = W.partitionBy(*key).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    bands = (
        points.groupBy(*key, "_band")
        .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        .select(
            *key, "_band",
            F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_n_lower"),
            F.coalesce(F.sum("_s").over(lower), F.lit(0)).alias("_s_lower"),
        )
    )
    n = F.col("_n") + F.col("_n_lower")
    s = F.col("_s") + F.col("_s_lower")
    answers = (
        inside.join(bands, [*key, "_band"])
        .filter(n > 0)
        .select(
            *key, point.alias(amount), (point * n - s).cast("decimal(38,6)").alias(out)
        )
    )
    return lines.join(answers, [*key, amount], "left")
