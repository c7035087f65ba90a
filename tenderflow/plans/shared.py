"""Sub-plans that several statements of a run have in common."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator, Mapping
from threading import Lock

from pyspark.sql import DataFrame

from tenderflow.sources.staging import stage

Tables = Mapping[str, DataFrame]


class Shared(Mapping[str, DataFrame]):
    """The tables of one run, and what its statements have asked to be kept.

    A frame is written to the staging folder when the first statement needs it and read by all
    others; statements that need it meanwhile wait.  One that fails is tried again by the next.
    """

    def __init__(self, tables: Tables):
        self._tables = tables
        self._kept: dict[Hashable, DataFrame] = {}
        self._locks: dict[Hashable, Lock] = defaultdict(Lock)
        self._guard = Lock()

    def __getitem__(self, name: str) -> DataFrame:
        with self._guard:
            return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def once(self, key: Hashable, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._guard:
            lock = self._locks[key]
        with lock:
            if key not in self._kept:
                self._kept[key] = stage(build(), name)
            return self._kept[key]


def once(
    tables: Tables, name: str, asked: Hashable, build: Callable[[], DataFrame]
) -> DataFrame:
    """What ``build`` gives for ``asked``: stored once in a run, and else a plan like any other."""
    if isinstance(tables, Shared):
        return tables.once((name, asked), name, build)
    return build()


def run_of(tables: Tables) -> Shared:
    """The run a statement belongs to, or one of its own."""
    return tables if isinstance(tables, Shared) else Shared(tables)
