import hashlib
from collections import Counter

import corpus
import pytest
from pyspark.sql import functions as F

from tenderflow.llm import exact


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(corpus.fold(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("key", [exact.text_key, lambda text: F.pmod(exact.text_key(text), F.lit(3))])
@pytest.mark.parametrize("capacity", [4, exact.BUCKET_ENTRIES])
def test_groups_with_chains_and_full_buckets(spark, key, capacity):
    docs = corpus.with_clashes(corpus.awkward(spark))
    found = exact.exact_groups(docs, capacity, key).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found)
    assert got == expected(corpus.awkward_rows())
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_buckets_are_split_and_cover_their_keys(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("n"))
    heavy = spark.createDataFrame([(7, 500)], "h long, n long")
    placed = exact.place_keys(keys.unionByName(heavy), 64).collect()
    assert len(placed) == 3001
    load = Counter()
    for row in placed:
        depth = row.bucket.bit_length() - 1
        assert row.bucket == 1 << depth | ((row.h % 2**64) >> (64 - depth) if depth else 0)
        load[row.bucket] += row.n if row.n <= 64 else 0
    assert max(load.values()) <= 64
    assert [row.pages for row in placed if row.n == 500] >= [8]


def test_filter_keeps_one_whole_row_of_each_text(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({corpus.fold(r.text) for r in rows})
    assert {corpus.fold(r.text) for r in rows} == {
        corpus.fold(r[1]) for r in corpus.awkward_rows()
    }


def test_no_rows(spark):
    assert exact.exact_groups(corpus.empty(spark)).count() == 0
    assert exact.drop_exact_duplicates(corpus.empty(spark)).count() == 0
