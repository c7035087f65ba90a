"""Ordered text lists and conditional sums over property tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import code_like


def _listing(value: str, times: str, out: str, where: str | None = None) -> Column:
    repeated = f"array_join(array_repeat({value}, cast({times} as int)), ', ')"
    listed = f"listagg({repeated}, ', ') within group (order by {value})"
    return F.expr(f"{listed} filter (where {where})" if where else listed).alias(out)


def ordered_listing(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Values of each key in text order, separated by ', '; NULLs skipped, repeats kept.

    Repeats are counted before the values of a key meet, so a key with very many rows sends
    each different value once.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_times"))
    )
    return counted.groupBy(*keys).agg(_listing(value, "_times", out))


def property_summary(
    df: DataFrame,
    keys: list[str],
    listed: Mapping[str, str],
    summed: Mapping[str, str] | None = None,
) -> DataFrame:
    """Several look-ups by code prefix in one pass of a property table.

    ``listed`` maps an output column to the prefix whose texts it lists, ``summed`` to the
    prefix whose amounts it adds (a missing amount counts as zero).  A key without any row of
    a prefix gets NULL.
    """
    summed = summed or {}
    prefixes = {**listed, **summed}
    marks = {out: f"_is_{position}" for position, out in enumerate(prefixes)}
    wanted = F.lit(False)
    for prefix in prefixes.values():
        wanted |= code_like(F.col("property_code"), prefix)
    marked = df.filter(wanted).select(
        *keys,
        "string_value",
        F.coalesce("decimal_value", F.lit(0).cast("decimal(17,6)")).alias("_amount"),
        *[code_like(F.col("property_code"), prefixes[out]).alias(marks[out]) for out in prefixes],
    )
    counted = marked.groupBy(*keys, "string_value", *marks.values()).agg(
        F.count("*").alias("_times"), F.sum("_amount").alias("_amount")
    )
    lists = [
        _listing("string_value", "_times", out, f"{marks[out]} and string_value is not null")
        for out in listed
    ]
    sums = [F.expr(f"sum(_amount) filter (where {marks[out]})").alias(out) for out in summed]
    return counted.groupBy(*keys).agg(*lists, *sums)
