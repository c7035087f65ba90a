"""Pairs of a Spark query and its SQL, and the parameters all of them use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tenderflow.checks.views import with_views
from tenderflow.params import ReportParams, Window
from tenderflow.sources.from_orders import order_tables

DAY = ReportParams(Window.day(date(2024, 1, 3)))
WEEK = ReportParams(Window(date(2024, 1, 1), date(2024, 1, 7)))
AS_OF_DAILY = date(2024, 1, 5)
AS_OF_WEEKLY = date(2024, 1, 8)


@dataclass(frozen=True)
class Check:
    build: Callable
    sql: str | None

    def query(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(order_tables(spark, root))


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Register a function of the point-of-sale tables, and the SQL that has to agree."""

    def register(build):
        if name in CHECKS:
            raise ValueError(f"query registered twice: {name}")
        CHECKS[name] = Check(build, with_views(sql) if sql else None)
        return build

    return register
