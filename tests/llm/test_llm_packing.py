import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderflow.llm import packing, tokens
from tenderflow.llm.queries import WORD_TOKENIZER, tokenizer_path

PATH = tokenizer_path(WORD_TOKENIZER)


def fewest(lengths, capacity):
    """The fewest bins by trying everything."""
    best = len(lengths)

    def place(rest, free):
        nonlocal best
        if len(free) >= best:
            return
        if not rest:
            best = len(free)
            return
        for space in {f for f in free if f >= rest[0]}:
            other = list(free)
            other.remove(space)
            place(rest[1:], [*other, space - rest[0]])
        place(rest[1:], [*free, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit_enclose_the_optimum(lengths):
    values = np.array(lengths)
    bins, offsets, free = packing.best_fit(values, 20)
    assert packing.lower_bound(values, 20) <= fewest(lengths, 20) <= len(free)
    for number, space in enumerate(free):
        mine = sorted(zip(offsets[bins == number], values[bins == number], strict=True))
        ends = np.cumsum([length for _, length in mine])
        assert [o for o, _ in mine] == [0, *ends[:-1]] and ends[-1] == 20 - space


def check(rows, capacity):
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(sequences)


def test_awkward_documents(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows, 2048)
    tokenizer = tokens.load_tokenizer(PATH)
    want = Counter()
    for doc_id, text, *_ in corpus.awkward_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[doc_id, piece, start, len(part), crc] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(corpus.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("size", [50, 100_000])
def test_exchange_comes_near_the_bound_of_all(spark, size):
    random = np.random.default_rng(3)
    lengths = random.integers(1, 1500, 2000)
    pieces = spark.createDataFrame(
        [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES
    )
    alone = check(packing.pack(pieces, 2048, size, rounds=0).collect(), 2048)
    rows = packing.pack(pieces, 2048, size).collect()
    assert sorted(r.length for r in rows) == sorted(lengths.tolist())
    used, bound = check(rows, 2048), packing.lower_bound(lengths, 2048)
    assert bound <= used <= alone
    assert used <= bound + (3 if size > 2000 else 20)


def test_equal_pieces_spread_over_partitions(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 700, 0)] * 3000, packing.PIECES)
    for rounds in (0, packing.ROUNDS):
        rows = packing.pack(pieces, 2048, 100, rounds).collect()
        assert len(rows) == 3000 and {r.length for r in rows} == {700}
        check(rows, 2048)
        parts = Counter(r.sequence_id >> 24 for r in rows)
        assert len(parts) >= 25 and max(parts.values()) < 200
