"""Language identification by Bloom filters of letter n-grams, sliced by bit.

One table of bit masks holds a Bloom filter for each language: bit l of all masks together is the
filter of language l.  A look-up ANDs a few masks and so gets all languages that contain an n-gram.
An n-gram belongs to a language if it is common there and not much more common in another.
A text's n-grams are counted for each language, the count that false positives alone would give is
taken off, and the largest share decides.  Where no language contains any of them, as with large
alphabets most n-grams are rare, the letters alone decide, by a second table of the same kind that
leaves out none for being rare.

The n-gram of a letter is it with both its neighbours; other characters than letters count as one
and the same.  So a text has as many n-grams as letters, wherever it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

UNKNOWN = "und"
LEAST_RATE = 1e-5  # of a language's n-grams, so that a language has at most 100,000
LEAST_SHARE = 0.2  # of the n-gram's rate in the language where it is most common
HASHES = 4
BITS_PER_GRAM = 32
MOST_LANGUAGES = 1024
MOST_SEEN = 1 << 21  # n-grams that a task counts before it passes them on
CHUNK = 1 << 20  # characters handled at once
ALONE = 0x1FFFFF << 21  # the bits of an n-gram that are its letter
LETTER_WORTH = 0.01  # of a letter in the score of a text that only letters decide

SEEN = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()),
    T.StructField("n", T.LongType()),
])
GUESS = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
])


@cache
def _folded() -> np.ndarray:
    """For each code point its letter in lower case, or 0 for no letter."""
    folded = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        if chr(code).isalpha():
            lower = chr(code).lower()
            folded[code] = ord(lower) if len(lower) == 1 else code
    return folded


def grams(text: str, start: int, end: int) -> np.ndarray:
    """The n-grams of the letters of ``text[start:end]``: 21 bits for each letter and for each of
    its neighbours in the whole text, 0 for no letter."""
    around = text[max(0, start - 1):end + 1].encode("utf-32-le", "replace")
    codes = _folded()[np.frombuffer(around, np.uint32)]
    padded = np.pad(codes, (int(start == 0), int(end >= len(text))))
    letters = padded[1:-1]
    found = (padded[:-2] << 42) | (letters << 21) | padded[2:]
    return found[letters > 0]


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams with the numbers of their texts, for about ``CHUNK`` characters at a time; short
    texts share a chunk, a long one is cut."""
    parts, owners, size = [], [], 0
    for number, text in enumerate(texts):
        text = text or ""
        for start in range(0, len(text), CHUNK):
            end = min(start + CHUNK, len(text))
            found = grams(text, start, end)
            parts.append(found)
            owners.append(np.full(len(found), number))
            size += end - start
            if size >= CHUNK:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (text, lang) with a language."""

    def told(seen: dict) -> Iterator[pa.RecordBatch]:
        for lang, (found, n) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(found), pa.array(n)], names=SEEN.names
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64)
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            langs, names = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            texts = batch.column("text").to_pylist()
            for found, owners in chunks(texts):
                of = names[owners]
                for number in np.unique(of):
                    new, n = np.unique(found[of == number], return_counts=True)
                    old, m = seen.get(langs[number], (none, none))
                    both, at = np.unique(np.concatenate([old, new]), return_inverse=True)
                    counts = np.zeros(len(both), np.int64)
                    np.add.at(counts, at, np.concatenate([m, n]))
                    seen[langs[number]] = both, counts
                if sum(len(found) for found, _ in seen.values()) > MOST_SEEN:
                    yield from told(seen)
                    seen.clear()
        yield from told(seen)

    labelled = docs.where("lang is not null and text is not null").select("text", "lang")
    return labelled.mapInArrow(count, SEEN).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # positions x 64-bit words of languages
    chance: np.ndarray  # by language: that its filter holds an n-gram that isn't there
    common: int  # the language with most n-grams
    letters: LanguageFilters | None = None  # of letters alone

    def look_up(self, found: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of the languages that contain it."""
        mask = None
        for at in positions(found, len(self.masks)):
            mask = self.masks[at] if mask is None else mask & self.masks[at]
        return mask

    def hits(
        self, texts: list[str | None], bits: int = (1 << 63) - 1
    ) -> tuple[np.ndarray, np.ndarray]:
        """By text: n-grams in all, and hits in each language less those due to chance."""
        total = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for found, owners in chunks(texts):
            mask = self.look_up(found & bits)
            total += np.bincount(owners, minlength=len(texts))
            for number in range(len(self.languages)):
                bit = (mask[:, number // 64] >> np.uint64(number % 64)) & np.uint64(1)
                hits[:, number] += np.bincount(owners, weights=bit, minlength=len(texts))
        corrected = (hits - total[:, None] * self.chance) / (1 - self.chance)
        return total, np.maximum(corrected, 0)

    def guess(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits = self.hits(texts)
        worth = np.ones(len(texts))
        lost = np.flatnonzero((hits.max(axis=1) <= 0) & (total > 0))
        if len(lost) and self.letters:
            hits[lost] = self.letters.hits([texts[i] for i in lost], ALONE)[1]
            worth[lost] = LETTER_WORTH
        best = np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), self.common)
        top = worth * hits[np.arange(len(texts)), best]
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        names = [
            self.languages[number] if n else UNKNOWN
            for number, n in zip(best.tolist(), total, strict=True)
        ]
        return names, np.minimum(score, 1.0)


def positions(found: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``HASHES`` places of each n-gram in a table of ``size``, a power of two."""
    mixed = found.astype(np.uint64)
    for constant in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(constant)
    mixed ^= mixed >> np.uint64(33)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for number in range(HASHES):
        yield (mixed + np.uint64(number) * step) & np.uint64(size - 1)


def learn(
    docs: DataFrame, least_rate: float = LEAST_RATE, least_share: float = LEAST_SHARE
) -> LanguageFilters:
    """Filters from all rows of ``docs`` (text, lang).

    What comes to the driver has a bound: at most ``1 / least_rate`` n-grams and all letters of
    Unicode for a language, and more than ``MOST_LANGUAGES`` languages are an error.
    """
    ship_code(docs.sparkSession)
    counts = stage(count_grams(docs), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {row.lang: row.total for row in totals.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    common = max(range(len(languages)), key=lambda i: sizes[languages[i]])
    letter = F.col("gram").bitwiseAND(F.lit(ALONE))
    alone = counts.groupBy("lang", letter.alias("gram")).agg(F.sum("n").alias("n"))
    letters = _filters(alone, totals, languages, common, 0.0, least_share)
    return replace(
        _filters(counts, totals, languages, common, least_rate, least_share), letters=letters
    )


def _filters(
    counts: DataFrame, totals: DataFrame, languages: list[str], common: int, least_rate: float,
    least_share: float,
) -> LanguageFilters:
    """Filters of the n-grams of each language that are common enough there."""
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = (
        rates.where(F.col("rate") >= least_rate).join(tops, "gram")
        .where(F.col("rate") >= least_share * F.col("top")).select("lang", "gram").toArrow()
    )
    found = chosen.column("gram").to_numpy()
    number = {lang: i for i, lang in enumerate(languages)}
    of = np.array([number[lang] for lang in chosen.column("lang").to_pylist()], np.int64)
    most = int(np.bincount(of, minlength=len(languages)).max())
    size = 1 << max(10, (most * BITS_PER_GRAM - 1).bit_length())
    masks = np.zeros((size, -(-len(languages) // 64)), np.uint64)
    bit = np.uint64(1) << (of % 64).astype(np.uint64)
    for at in positions(found, size):
        np.bitwise_or.at(masks, (at.astype(np.int64), of // 64), bit)
    filled = [
        float(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
        for i in range(len(languages))
    ]
    return LanguageFilters(languages, masks, np.array(filled) ** HASHES, common)


def guesses(docs: DataFrame, filters: LanguageFilters) -> Column:
    """A column of (lang_pred, score) of ``docs.text``; the filters are sent to each task once."""
    if not filters.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf(GUESS)
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, score = sent.value.guess(batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return guess(docs["text"])


def in_training(doc_id: Column) -> Column:
    """False for about every fifth document; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the documents that aren't held out and have a language.  ``score`` is the share of
    the text's n-grams that its language contains; where none contains any, it is
    ``LETTER_WORTH`` times the share of its letters that the language has.  Null texts and those
    without a letter are ``und`` with score 0; a text with no letter that any language has gets the
    commonest language with score 0, and every text is ``und`` if nothing could be learned.
    Repeated rows each give a row; no rows give none; other columns are not read.
    """
    filters = learn(docs.where(in_training(docs["doc_id"])))
    guess = guesses(docs, filters)
    return docs.select(
        "doc_id", (~in_training(docs["doc_id"])).alias("held_out"), guess.alias("guess")
    ).select("doc_id", "held_out", "guess.lang_pred", "guess.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``identify`` calls ``und``.

    A text with letters stays also with score 0, which only says that no language has any of them.
    """
    filters = learn(docs.where(in_training(docs["doc_id"])))
    marked = docs.withColumn("__guess", guesses(docs, filters))
    return marked.where(F.col("__guess.lang_pred") != UNKNOWN).select(*docs.columns)
