"""Scalar look-ups: at most one value per row, checked."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_lookup(
    df: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    values: Mapping[str, Column],
    distinct: bool = False,
) -> DataFrame:
    """Add one value per output column from the matching row of ``dim``, NULL without a match.

    ``on`` maps columns of ``df`` to columns of ``dim``.  A second matching row raises an
    error when its key is looked up; with ``distinct``, only a second different value does.
    """
    keys = {mine: f"_on_{position}" for position, mine in enumerate(on)}
    candidates = dim.select(
        *[F.col(on[mine]).alias(keys[mine]) for mine in on],
        *[value.alias(out) for out, value in values.items()],
    )
    found = candidates.groupBy(*keys.values()).agg(
        F.count("*").alias("_rows"),
        *[F.max(out).alias(out) for out in values],
        *[F.min(out).alias(f"_min_{out}") for out in values],
        *[F.count(out).alias(f"_known_{out}") for out in values],
    )

    def checked(out: str) -> Column:
        if distinct:
            partly_null = F.col(f"_known_{out}").between(1, F.col("_rows") - 1)
            several = (F.col(out) != F.col(f"_min_{out}")) | partly_null
        else:
            several = F.col("_rows") > 1
        message = F.lit(f"look-up of {out} found more than one value")
        return F.when(several, F.raise_error(message).cast("string")).otherwise(F.col(out))

    matches = [F.col(mine) == F.col(keys[mine]) for mine in on]
    joined = df.join(found, reduce(and_, matches), "left")
    return joined.select(*df.columns, *[checked(out).alias(out) for out in values])
