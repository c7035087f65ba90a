"""Typed report parameters and the fixed day offsets of the scheduled runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from tenderflow.codes import Codes

# How many days before the run each report looks.
DAILY_LAG = 2
TILL_LAG = 1
ACH_FIRST_LAG = 7
ACH_LAST_LAG = 1


@dataclass(frozen=True)
class Window:
    """Closed range of days; a daily report is the window of one day."""

    start: date
    end: date

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"window ends before it starts: {self.start} .. {self.end}")

    @classmethod
    def day(cls, day: date) -> Window:
        return cls(day, day)


def daily_window(as_of: date) -> Window:
    return Window.day(as_of - timedelta(days=DAILY_LAG))


def till_window(as_of: date) -> Window:
    return Window.day(as_of - timedelta(days=TILL_LAG))


def ach_window(as_of: date) -> Window:
    return Window(as_of - timedelta(days=ACH_FIRST_LAG), as_of - timedelta(days=ACH_LAST_LAG))


@dataclass(frozen=True)
class ReportParams:
    """What a report run is asked for.

    ``store_pattern`` is a LIKE pattern on the store number; None takes every store.
    ``strict_keys`` matches till counts by their whole key only (see ``plans.over_short``).
    """

    window: Window
    organization_id: int = 1
    store_pattern: str | None = None
    strict_keys: bool = False
    codes: Codes = field(default_factory=Codes)
