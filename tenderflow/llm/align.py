"""Alignment of two tokenizations of whole texts.

Both tokenizers' tokens are bytes of the same text, so the ends of tokens, added up, are offsets in
it.  Each list's ends map to token indices in a dictionary; the ends that both dictionaries have
cut the two id lists into groups, and a group's tokens that end with it are linked.

A text is first cut at safe boundaries, where no token of either tokenizer reaches across, so
boundaries are common ends and a text's alignment is those of its units one after the other.  Units
repeat a lot, so a worker aligns one once and keeps a number of bytes of results.  Two linked
tokens end together, so the shorter is a suffix of the longer: how many different links there can
be follows from the vocabularies, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm import tokens
from tenderflow.llm.packing import byte_letters
from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

KEPT_BYTES = 160 << 20  # of results kept in each of two generations
LONGEST_KEPT = 256  # characters; longer units are aligned each time
OVERHEAD = 350  # bytes of a kept result beside its texts
MOST_SENT = 4 << 20  # different links that tasks are sent the counts of
SPACE = "▁"
MISSING = object()

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups string, codes array<long>, times array<int>"
)
SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups string, n_best long, count_sum long"
)


@dataclass(frozen=True)
class ByteTokenizer:
    """A byte-level BPE file of the tokenizers library; special strings are plain text."""

    path: str

    def load(self):
        found = tokens.load_tokenizer(self.path)
        found.encode_special_tokens = True
        return found

    def vocabulary(self) -> list[bytes]:
        found = self.load()
        bytes_of = {chr(byte): byte for byte in range(256)}
        for byte, letter in byte_letters().items():
            bytes_of.pop(chr(byte), None)
            bytes_of[chr(letter)] = byte
        by_id = {number: text for text, number in found.get_vocab(with_added_tokens=True).items()}
        special = set(found.get_added_tokens_decoder())
        return [
            b"" if i in special or i not in by_id else bytes(bytes_of[c] for c in by_id[i])
            for i in range(max(by_id) + 1)
        ]

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        """Ids of units.  Latin letters, with a space before them or not and marks after them or
        not, go straight to the model, in the letters it writes bytes with: the pattern makes the
        letters one pre-token and the marks another."""
        loaded, letters = self.load(), byte_letters()
        model = loaded.model

        space = chr(letters[ord(" ")])

        def direct(text: str) -> list[int]:
            if text.isascii():  # letters and marks are written as they are
                written = text.replace(" ", space)
            else:
                written = text.encode().decode("latin-1").translate(letters)
            return [token.id for token in model.tokenize(written)]

        marks = lru_cache(4096)(direct)

        def encode(units: list[str]) -> list[list[int]]:
            found, other = [], []
            for unit in units:
                head = unit.rstrip(tokens.PUNCTUATION)
                word = head.removeprefix(" ")
                if word.isalpha() and max(word) < "Ā":
                    rest = unit[len(head):]
                    found.append(direct(head) + marks(rest) if rest else direct(head))
                else:
                    found.append(None)
                    other.append(unit)
            encoded = iter(loaded.encode_batch_fast(other, add_special_tokens=False))
            return [next(encoded).ids if ids is None else ids for ids in found]

        return encode


@dataclass(frozen=True)
class PieceTokenizer:
    """A sentencepiece model that puts a space before a text and falls back to bytes."""

    path: str

    def load(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.path)

    def vocabulary(self) -> list[bytes]:
        found = self.load()
        pieces = [found.id_to_piece(i) for i in range(found.vocab_size())]
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in pieces):
            raise ValueError("a piece reaches across a space or a line feed")
        return [
            bytes([int(piece[3:-1], 16)]) if found.is_byte(i) else
            b"" if found.is_control(i) or found.is_unknown(i) else
            piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        """The space the model adds is a unit's own first space; units that have none follow or
        are a line feed, and go after one that is taken off again."""
        loaded = self.load()

        def encode(units: list[str]) -> list[list[int]]:
            asked = [unit[1:] if unit[0] == " " else "\n" + unit for unit in units]
            ids = loaded.encode(asked, num_threads=1)
            return [i if unit[0] == " " else i[2:] for i, unit in zip(ids, units, strict=True)]

        return encode


def units_of(text: str) -> list[str]:
    """A space and the text, in units that no token of either tokenizer reaches across."""
    units = tokens.byte_units(text)
    units[0] = " " + units[0]
    return units


def slices(ends_a: Iterable[int], ends_b: Iterable[int]) -> list[tuple[int, int]]:
    """The numbers of A and B tokens up to and with each common end."""
    index_a = {end: i for i, end in enumerate(ends_a, 1)}
    index_b = {end: i for i, end in enumerate(ends_b, 1)}
    return [(index_a[end], index_b[end]) for end in sorted(index_a.keys() & index_b.keys())]


class Aligner:
    """Alignments of units: (number of A ids, of B ids, text of the groups, codes of links), or
    None if a tokenizer's bytes are not the unit's.  What was used lately stays, up to about
    ``most`` bytes twice."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer, most: int = KEPT_BYTES):
        self.encode_a, self.encode_b, self.most = a.encoder(), b.encoder(), most
        self.bytes_a, self.bytes_b = a.vocabulary(), b.vocabulary()
        self.lengths_a, self.lengths_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.now, self.before, self.size = {}, {}, 0

    def _right(self, units: list[str], ids: list[list[int]], bytes_of: list[bytes]) -> list[bool]:
        """Which units the tokens' bytes are."""
        return [
            b"".join(map(bytes_of.__getitem__, own)) == unit.encode()
            for unit, own in zip(units, ids, strict=True)
        ]

    def align(self, units: list[str]) -> list:
        """Alignments of units one after the other, so that ends are offsets in all of them."""
        ids_a, ids_b = self.encode_a(units), self.encode_b(units)
        right = [a and b for a, b in zip(
            self._right(units, ids_a, self.bytes_a), self._right(units, ids_b, self.bytes_b),
            strict=True,
        )]
        if not all(right):
            units, ids_a, ids_b = [list(compress(part, right)) for part in (units, ids_a, ids_b)]
        flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        cuts = slices(
            accumulate(map(self.lengths_a.__getitem__, flat_a)),
            accumulate(map(self.lengths_b.__getitem__, flat_b)),
        )
        names_a, names_b = (list(map(self.names.__getitem__, flat)) for flat in (flat_a, flat_b))
        base, texts, codes, i, j = len(self.bytes_b), [], array("q"), 0, 0
        for to_a, to_b in cuts:
            if to_a - i == 1 and to_b - j == 1:
                texts.append(names_a[i] + "|" + names_b[j])
            else:
                texts.append(",".join(names_a[i:to_a]) + "|" + ",".join(names_b[j:to_b]))
            # no token is empty, so only the last ones end with the group
            codes.append(flat_a[to_a - 1] * base + flat_b[to_b - 1])
            i, j = to_a, to_b
        # a unit's end is a common end: the groups up to it are those up to its last A token
        sizes_a, sizes_b = list(map(len, ids_a)), list(map(len, ids_b))
        last = np.searchsorted([to_a for to_a, _ in cuts], np.cumsum(sizes_a)) + 1
        packed, found, begin = codes.tobytes(), [], 0
        for n_a, n_b, end in zip(sizes_a, sizes_b, last.tolist(), strict=True):
            found.append((n_a, n_b, ";".join(texts[begin:end]), packed[8 * begin:8 * end]))
            begin = end
        if all(right):
            return found
        known = iter(found)
        return [next(known) if one else None for one in right]

    def learn(self, units: list[str]) -> list:
        """The alignments of different ``units``."""
        if self.size > self.most:
            self.now, self.before, self.size = {}, self.now, 0
        found, missing = list(map(self.now.get, units, repeat(MISSING))), []
        for i, unit in enumerate(units):
            if found[i] is MISSING:
                found[i] = self.before.get(unit, MISSING)
                if found[i] is MISSING:
                    missing.append(i)
                else:
                    self._keep(unit, found[i])
        at = 0
        for batch in tokens.balanced(units[i] for i in missing):
            for unit, one in zip(batch, self.align(batch), strict=True):
                found[missing[at]] = one
                self._keep(unit, one)
                at += 1
        return found

    def _keep(self, unit: str, found) -> None:
        if len(unit) <= LONGEST_KEPT:
            self.now[unit] = found
            self.size += OVERHEAD + 2 * len(unit) + (len(found[2]) + len(found[3]) if found else 0)


#: of the worker, over all its tasks
_aligners: dict[tuple[ByteTokenizer, PieceTokenizer], Aligner] = {}


def documents(texts: list[str | None], aligner: Aligner, groups: bool) -> list[list]:
    """Columns of ``ALIGNED`` but the first, by text: what its units have, one after the other."""
    units = [units_of(text) if text else [] for text in texts]
    sizes = list(map(len, units))
    coded = pa.array(list(chain.from_iterable(units)), pa.string()).dictionary_encode()
    found = aligner.learn(coded.dictionary.to_pylist())
    wrong = np.array([one is None for one in found], bool)
    known = [one or (0, 0, "", b"") for one in found]
    n_a = np.array([one[0] for one in known], np.int64)
    n_b = np.array([one[1] for one in known], np.int64)
    told, packed = [one[2] for one in known], [one[3] for one in known]
    codes = coded.indices.to_numpy()
    columns = [[] for _ in range(8)]
    start = 0
    for size in sizes:
        own = codes[start:start + size]
        start += size
        if not size or wrong[own].any():
            row = (0, 0, 0, 0, "", "", [], [])
        else:
            numbers = own.tolist()
            text = ";".join(map(told.__getitem__, numbers))
            links = np.frombuffer(b"".join(map(packed.__getitem__, numbers)), np.int64)
            different, times = np.unique(links, return_counts=True)
            # one link ends each group
            row = (int(n_a[own].sum()), int(n_b[own].sum()), len(links), len(links),
                   hashlib.sha256(text.encode()).hexdigest(), text, different, times)
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    if not groups:
        columns[5] = [None] * len(texts)
    return columns


def align(docs: DataFrame, a: ByteTokenizer, b: PieceTokenizer, groups: bool = False) -> DataFrame:
    """The alignment of each row of ``docs`` (doc_id, text), and its different links with how
    often it has each; ``groups`` asks for the groups' text as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a, b) not in _aligners:
            _aligners[a, b] = Aligner(a, b)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()),
                 pa.list_(pa.int32())]
        names = [part.split()[0] for part in ALIGNED.split(", ")]
        for rows in tokens.portions(batches, "text"):
            columns = documents(rows.column("text").to_pylist(), _aligners[a, b], groups)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *made], names=names)

    ship_code(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, ALIGNED)


def most_links(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens can end together: those where one is a suffix of the other."""
    in_a, in_b = Counter(filter(None, a)), Counter(filter(None, b))
    longer_a = sum(n * in_b[t[i:]] for t, n in in_a.items() for i in range(len(t)))
    return longer_a + sum(n * in_a[t[i:]] for t, n in in_b.items() for i in range(1, len(t)))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): how many links of the corpus each pair of ids has."""
    each = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("link"))
    return each.groupBy(F.col("link.codes").alias("code")).agg(
        F.sum(F.col("link.times").cast("long")).alias("n")
    )


def _sent(aligned: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """Scores by counts that every task has."""
    table = counts.orderBy("code").toArrow()
    codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, codes % size_b, n)
    sent = aligned.sparkSession.sparkContext.broadcast((codes, n, n == best[codes % size_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, is_best = sent.value
        for rows in batches:
            own, times = rows.column("codes"), rows.column("times")
            ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            at = np.searchsorted(codes, own.flatten().to_numpy())
            flat = times.flatten().to_numpy().astype(np.int64)
            sums = []
            for weight in (is_best[at] * flat, n[at] * flat):
                total = np.concatenate([[0], np.cumsum(weight)])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            kept = [rows.column(name) for name in rows.schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*kept, *sums], names=[*rows.schema.names[:-2], "n_best", "count_sum"]
            )

    return aligned.mapInArrow(run, SCORED)


def _joined(aligned: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """The same by joins, for vocabularies with too many possible links to send."""
    bests = counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("best"))
    rated = stage(
        counts.join(bests, F.col("code") % size_b == F.col("b"))
        .select("code", "n", (F.col("n") == F.col("best")).alias("is_best")),
        "rated",
    )
    numbered = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "numbered")
    each = numbered.select("row", F.explode(F.arrays_zip("codes", "times")).alias("link"))
    times = F.col("link.times").cast("long")
    sums = each.join(rated, F.col("link.codes") == F.col("code")).groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), times).otherwise(0)).alias("n_best"),
        F.sum(times * F.col("n")).alias("count_sum"),
    )
    none = {"n_best": 0, "count_sum": 0}
    return numbered.drop("codes", "times").join(sums, "row", "left").drop("row").fillna(none)


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, groups: bool = False, most: int = MOST_SENT
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, groups (null unless asked for), n_best, count_sum.

    ``path_a`` names a byte-level BPE file, ``path_b`` a sentencepiece model; both read a space
    and the text.  Groups end where tokens of both end; a link is a pair of tokens that end
    together.  A pair of ids counts its links in the whole corpus; a document's ``count_sum`` adds
    these counts up over its links, and ``n_best`` are those links whose count is the highest that
    their B id has, ties included.

    Null and empty texts, and those of which a tokenizer's tokens are other bytes, have no tokens:
    zeros, and an empty hash.  A text without a safe boundary is one unit, however long.  Repeated
    rows each give a row and count each; no rows give no rows; other columns are not read.
    """
    a, b = ByteTokenizer(path_a), PieceTokenizer(path_b)
    vocabulary_a, vocabulary_b = a.vocabulary(), b.vocabulary()
    aligned = stage(align(docs, a, b, groups), "aligned")
    counts = stage(link_counts(aligned), "links")
    few = most_links(vocabulary_a, vocabulary_b) <= most
    return (_sent if few else _joined)(aligned, counts, len(vocabulary_b))
