"""Token counts and token ids of whole texts, by the tokenizers library.

A text is cut at safe boundaries, where no token of the whole text can reach across; the units
repeat a lot, so a worker encodes a unit once and keeps results up to a number of bytes, also for
its later tasks.  Units are encoded in batches of about equal bytes, and rows are taken in portions
of about equal bytes, so neither many short nor a few very long texts make a large batch.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenderflow.llm.ship import ship_code

PORTION_BYTES = 4 << 20  # of texts handled at once
BATCH_BYTES = 256 << 10  # of units encoded at once
KEPT_BYTES = 120 << 20  # of results kept in each of two generations
LONGEST_KEPT = 256  # characters; longer units are encoded each time
OVERHEAD = 250  # bytes of a kept result beside its unit and value
#: Without the apostrophe, which can open a pre-token that has letters.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: A lone space between two other characters opens a pre-token of its own.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def portions(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of about ``PORTION_BYTES`` of ``column``."""
    for batch in batches:
        start = size = 0
        at = batch.schema.get_field_index(column)
        for i, value in enumerate(batch.column(at)):
            size += len(value.as_buffer() or b"") if value.is_valid else 0
            if size >= PORTION_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def balanced(units: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of units with about ``most`` characters each; a longer unit is a list of its own."""
    batch, size = [], 0
    for unit in units:
        if batch and size + len(unit) > most:
            yield batch
            batch, size = [], 0
        batch.append(unit)
        size += len(unit) + 16
    if batch:
        yield batch


class Kept:
    """Results by unit; what was used lately stays, up to about ``most`` bytes twice.

    A unit with marks after its letters is made of two parts, each encoded once.
    """

    def __init__(self, encode, join, canonical=lambda unit: unit, most: int = KEPT_BYTES):
        self.encode, self.join, self.canonical = encode, join, canonical
        self.most, self.size, self.now, self.before = most, 0, {}, {}

    def _keep(self, unit: str, value, into: dict) -> None:
        if len(unit) > LONGEST_KEPT:
            into[unit] = value
        elif unit not in self.now:
            self.now[unit] = value
            self.size += OVERHEAD + 2 * len(unit) + (len(value) if isinstance(value, bytes) else 0)

    def learn(self, units: set[str]) -> dict:
        """Results by unit, with all of ``units`` among them."""
        if self.size > self.most:
            self.now, self.before, self.size = {}, self.now, 0
        now, before = self.now, self.before
        passing, split, whole = {}, {}, set()
        for unit in units.difference(now):
            if unit in before:
                self._keep(unit, before[unit], passing)
                continue
            parts = [self.canonical(part) for part in word_and_mark(unit)]
            if parts == [unit]:
                whole.add(unit)
            else:
                split[unit] = parts
                whole.update(parts)
        missing = []
        for unit in whole.difference(now):
            if unit in before:
                self._keep(unit, before[unit], passing)
            else:
                missing.append(unit)
        for batch in balanced(missing):
            for unit, value in zip(batch, self.encode(batch), strict=True):
                self._keep(unit, value, passing)
        known = ChainMap(passing, now) if passing else now
        for unit, parts in split.items():
            self._keep(unit, self.join([known[part] for part in parts]), passing)
        return now | passing if passing else now


_of_worker: dict[tuple, Kept] = {}


def kept_by_worker(make, path: str) -> Kept:
    """What this worker keeps for a tokenizer, over all its tasks."""
    if (make, path) not in _of_worker:
        _of_worker[make, path] = make(path)
    return _of_worker[make, path]


def word_and_mark(unit: str) -> list[str]:
    """Letters before a run of ASCII marks are cut from it, where both patterns cut too, if they
    are still letters in lower case."""
    word = unit.rstrip(PUNCTUATION)
    if word != unit and word.lstrip(" ").lower().isalpha() and word.lstrip(" ").isalpha():
        return [word, unit[len(word):]]
    return [unit]


def byte_units(text: str) -> list[str]:
    """Cut a text where a byte-level tokenizer with the usual pattern always cuts: before a lone
    space and round a lone line feed.  Special strings have no white space and so stay whole."""
    # equal only if all white space is spaces and line feeds, each between two words
    if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    units, start = [], 0
    for cut in LONE_SPACE.finditer(text):
        units.append(text[start:cut.start()])
        start = cut.start()
    return [*units, text[start:]]


def counter(path: str) -> Kept:
    """Numbers of tokens by unit."""
    tokenizer = load_tokenizer(path)

    def lengths(batch: list[str]) -> list[int]:
        return list(map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)))

    return Kept(lengths, sum)


COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of ``docs`` (doc_id, text).

    ``path`` names a byte-level BPE file of the tokenizers library.  Counts are those of whole
    texts, without added special tokens; special strings in a text count as the library counts
    them by default.  Null and empty texts have no bytes and no tokens.  A text without a safe
    boundary is one unit.  Repeated rows each give a row; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker(counter, path)
        for rows in portions(batches, "text"):
            texts = [text or "" for text in rows.column("text").to_pylist()]
            units = [byte_units(text) for text in texts]
            known = kept.learn(set().union(*units))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array([sum(map(known.__getitem__, one)) for one in units], pa.int64()),
                ],
                names=COUNTS.names,
            )

    ship_code(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(count, COUNTS)
