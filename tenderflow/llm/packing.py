"""Documents packed into sequences of bounded length, with certified numbers of sequences.

Each partition of pieces is packed by best-fit decreasing and gets a lower bound on its number of
sequences from dual feasible functions.  Where the two agree, the partition is certified.  Then
partitions exchange: those with a gap give the pieces of all sequences that aren't full, certified
ones those of their emptiest sequence, which only rounding made.  The pieces given are dealt to
new, fewer partitions and packed again, and the new packing counts if it has fewer sequences.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm import tokens
from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

CAPACITY = 2048
PARTITION_PIECES = 50_000
ROUNDS = 4
END_ID = 0

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])
NUMBERED = T.StructType([*PIECES.fields, T.StructField("number", T.LongType())])
PACKED = T.StructType([
    *NUMBERED.fields,
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("gap", T.IntegerType()), T.StructField("loose", T.BooleanType()),
])


def token_bytes(path: str) -> tokens.Kept:
    """Token ids by unit, as little-endian unsigned 32-bit numbers.

    Lower-case letters that need no normalising go straight to the tokenizer's model, in the
    letters it writes bytes with; that takes a third of the time of the whole encoding.
    """
    tokenizer = tokens.load_tokenizer(path)
    model, letters = tokenizer.model, byte_letters()

    def encode(batch: list[str]) -> list[bytes]:
        plain = [u for u in batch if u.isalpha() and u.islower() and max(u) < "Ā"]
        found = {}
        for unit in plain:
            written = unit if unit.isascii() else unit.encode().decode("latin-1").translate(letters)
            found[unit] = [token.id for token in model.tokenize(written)]
        other = [unit for unit in batch if unit not in found]
        encoded = tokenizer.encode_batch(other, add_special_tokens=False)
        found.update(zip(other, [one.ids for one in encoded], strict=True))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(found.__getitem__, batch)]

    return tokens.Kept(encode, b"".join, lower_latin)


def byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte as its Latin-1 character if that shows, and the others
    as the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in shown]
    return dict(zip(others, range(256, 256 + len(others)), strict=True))


def lower_latin(unit: str) -> str:
    """Letters up to ÿ in lower case, as the tokenizer's own normalising leaves them."""
    return unit.lower() if unit.isalpha() and max(unit) < "Ā" else unit


def word_units(texts: pa.Array) -> pa.ListArray:
    """Words between spaces and line feeds; no token of a word tokenizer reaches across them."""
    return pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")


def joined_ids(units: pa.ListArray, kept: tokens.Kept) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given by their units, each text's followed by the closing id, and where
    each text's ids end.

    Only different units are looked up; ids are then put together by number.
    """
    coded = units.flatten().dictionary_encode()
    different = coded.dictionary.to_pylist()
    known = kept.learn(set(different))
    parts = [*map(known.__getitem__, different), np.array([END_ID], "<u4").tobytes()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(sizes) - sizes
    last = np.cumsum(units.value_lengths().to_numpy())
    order = np.insert(coded.indices.to_numpy(), last, len(different))
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1]) + np.repeat(starts[order] - ends + lengths, lengths)
    return np.frombuffer(b"".join(parts), "<u4")[place], ends[last + np.arange(len(last))]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids and a closing id: only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tokens.kept_by_worker(token_bytes, path)
        for rows in tokens.portions(batches, "text"):
            ids, ends = joined_ids(word_units(rows.column("text")), kept)
            body = memoryview(ids).cast("B")
            columns = [[], array("i"), array("q"), array("q"), array("q")]
            begin = 0
            for doc_id, end in zip(rows.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for piece, start in enumerate(range(begin, end, capacity)):
                    stop = min(start + capacity, end)
                    crc = zlib.crc32(body[4 * start:4 * stop])
                    values = (doc_id, piece, start - begin, stop - start, crc)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _arrow(PIECES), strict=True)],
                schema=_arrow(PIECES),
            )

    ship_code(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(cut, PIECES)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the bins' free space.

    Bins with the same free space are alike, so they wait in one list per free space; the bits
    of ``open_`` say which lists have any.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    free: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_ >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = waiting[space].pop()
            if not waiting[space]:
                open_ ^= 1 << space
        else:
            space, chosen = capacity, len(free)
            free.append(capacity)
        bins[item], offsets[item] = chosen, capacity - space
        left = space - length
        free[chosen] = left
        if left:
            waiting[left].append(chosen)
            open_ |= 1 << left
    return bins, offsets, free


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of three families of dual feasible functions on the number of bins.

    A function is dual feasible if the values of items that fit one bin add up to one at most, so
    the sum of all values is a bound.  Used: the size itself; sizes with those below k dropped and
    those above capacity - k raised to one, for all k up to half; sizes rounded down to multiples
    of 1 / k by floor((k + 1) x) / k, where (k + 1) x is no whole number.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    items, total = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, capacity // 2 + 1)
    large = items[-1] - items[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(-(-int(total[-1]) // capacity), int((large - (-middle // capacity)).max()))
    for k in range(1, 33):
        steps, rest = np.divmod((k + 1) * size, capacity)
        # in units of 1 / (k * capacity)
        value = np.where(rest == 0, k * size, steps * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(round_: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in NUMBERED.names])
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        gap = len(free) - lower_bound(lengths, capacity)
        spare = np.array(free)
        loose = spare > 0 if gap else spare == max(1, spare.max())
        if not gap:  # the emptiest sequence alone
            loose[np.flatnonzero(loose)[1:]] = False
        first = (round_ << 56) + (rows.column("part")[0].as_py() << 24)
        new = [first + bins, offsets, np.full(len(bins), gap, np.int32), loose[bins]]
        columns = [rows.column(name) for name in NUMBERED.names] + [pa.array(c) for c in new]
        return pa.Table.from_arrays(columns, schema=_arrow(PACKED))

    return pack


def _deal(pieces: DataFrame, round_: int, capacity: int, size: int) -> DataFrame:
    """Deal numbered pieces out by a hash, about ``size`` to a partition, and pack each partition;
    the number spreads equal pieces."""
    ship_code(pieces.sparkSession)
    parts = max(1, -(-pieces.count() // size))
    part = F.pmod(F.xxhash64(F.lit(round_), *NUMBERED.names), F.lit(parts))
    return stage(
        pieces.withColumn("part", part).groupBy("part")
        .applyInArrow(_packer(round_, capacity), PACKED),
        f"packed-{round_}",
    )


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, size: int = PARTITION_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The pieces are stored once with a number each, so that what a task does again has the same.
    A sequence has at most ``capacity`` tokens and its pieces lie without gaps from offset 0.
    ``gap`` is the number of sequences of its last partition above the bound.
    """
    sequences = F.count_distinct("sequence_id")
    numbered = stage(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    packed = _deal(numbered, 0, capacity, size)
    done = []
    for round_ in range(1, rounds + 1):
        given = packed.where("loose")
        before = given.agg(sequences).first()[0]
        if before < 2:
            break
        again = _deal(given.select(*NUMBERED.names), round_, capacity, size)
        if again.agg(sequences).first()[0] >= before:
            break
        done.append(packed.where("not loose"))
        packed = again
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("number", "loose")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, gap.

    ``path`` names a word-level BPE file of the tokenizers library.  Null text is empty: one
    piece, the closing id.  Repeated rows are packed one by one; a null doc_id is kept.  No rows
    give no sequences.  Other columns are not read.
    """
    return pack(cut_pieces(docs, path, capacity), capacity)
