import random

import corpus
import xxhash

from tenderflow.llm import simhash


def plain_print(text, size=3):
    words = corpus.WHITE.findall(corpus.fold(text))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def test_fingerprints_of_awkward_texts(monkeypatch):
    texts = [row[1] for row in corpus.awkward_rows()]
    for slice_bytes in (simhash.SLICE_BYTES, 7):
        monkeypatch.setattr(simhash, "SLICE_BYTES", slice_bytes)
        for text in texts:
            if slice_bytes > 7 or len(text or "") < 1000:
                assert simhash.fingerprint(text) % 2**64 == plain_print(text)


def test_groups(spark):
    rows = corpus.awkward_rows()
    docs = corpus.with_clashes(corpus.awkward(spark))
    prints = [plain_print(row[1]) for row in rows]
    roots = corpus.roots_of(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    want = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]]
        smallest = min((d for d in ids if d is not None), default=None)
        want.append((row[0], f"{prints[i]:016x}", smallest))
    found = simhash.simhash_groups(docs)
    assert corpus.rows_of(found) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (min((rows[j][0] for j in range(len(rows)) if roots[j] == root and rows[j][0] is not None),
             default=None) for root in set(roots)), key=repr,
    )


def test_all_levels_find_every_pair(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for center in list(prints)[:6]:
        near = {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
        prints |= near | {p ^ (3 << rng.randrange(62)) for p in near}
    prints = sorted(prints)
    roots = corpus.roots_of(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    frame = spark.createDataFrame(
        [(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long"
    ).repartition(3)
    for compared in (2, 20, simhash.COMPARED):
        links = simhash.linked_fingerprints(frame, compared=compared).collect()
        at = {p: i for i, p in enumerate(prints)}
        linked = {frozenset((at[r.a % 2**64], at[r.b % 2**64])) for r in links}
        assert corpus.roots_of(len(prints), lambda a, b: frozenset((a, b)) in linked) == roots


def test_no_rows(spark):
    assert simhash.simhash_groups(corpus.empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(corpus.empty(spark)).count() == 0
