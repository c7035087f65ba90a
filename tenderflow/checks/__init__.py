"""Every operator and report as a query on the given tables, with the same question in SQL."""

from tenderflow.checks import aggregates, joins, outputs, statements, scalars  # noqa: F401
from tenderflow.checks.register import CHECKS

__all__ = ["CHECKS"]
