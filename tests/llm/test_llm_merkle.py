import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus
import pytest

from tenderflow.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}"
              for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(values))


def grow(digests):
    """Root, and for each leaf its (before, after) lists by level."""
    ways, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, held = [], []
        for at in range(0, len(digests), 3):
            run = digests[at:at + 3]
            for i in range(len(run)):
                for one in under[at + i]:
                    ways[one].append((run[:i], run[i + 1:]))
            above.append(sha("".join(run)))
            held.append([one for part in under[at:at + 3] for one in part])
        digests, under = above, held
    return digests[0], ways


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        row = row[:5]
        told = leaf(*row)
        cut = None
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
            cut = leaf(row[0], row[1] and row[1].replace("\n", ""), *row[2:])
        groups[row[3]].append((row[0] is not None, row[0] or 0, told, cut, row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([m[2] for m in sorted(groups[s], key=lambda m: m[:3])]) for s in names]
    root, top = grow([subroot for subroot, _ in trees]) if trees else (None, [])
    out = Counter()
    for name, (subroot, ways), above in zip(names, trees, top, strict=True):
        for member, way in zip(sorted(groups[name], key=lambda m: m[:3]), ways, strict=True):
            way = way + above
            proof = sha("".join("".join(b + a) for b, a in way))
            folded = member[3] or member[2]
            for before, after in way:
                folded = sha("".join([*before, folded, *after]))
            out[member[4], member[2], subroot, root, proof, folded, folded == root] += 1
    return out


def found(docs):
    rows = merkle.verified(merkle.manifest(docs, merkle.tampered_leaf(docs))).collect()
    return Counter(tuple(row) for row in rows)


def test_awkward_documents(spark):
    docs = corpus.with_clashes(corpus.awkward(spark)).withColumnsRenamed({"n": "pos", "key": "tree"})
    got = found(docs)
    assert got == plain(corpus.awkward_rows())
    assert {row[-1] for row in got} == {True, False}


@pytest.mark.parametrize("count", [1, 10, 82])
def test_trees_of_all_shapes(spark, count):
    rng = random.Random(count)
    rows = [(i, f"a\n{i}" if i % 3 else None, "en", rng.choice([None, "a", "é", "b"]), i)
            for i in range(count)]
    docs = spark.createDataFrame(rows, corpus.DOCUMENTS)
    assert found(docs) == plain(rows)


def test_one_source_many_sources_and_equal_rows(spark):
    one = [(7, "x", "en", "s", 1)] * 40 + [(i, "y\n", None, "s", None) for i in range(200)]
    many = [(i, "y\n", None, f"s{i % 150}", None) for i in range(200)]
    for rows in (one, many):
        assert found(spark.createDataFrame(rows, corpus.DOCUMENTS).repartition(5)) == plain(rows)


def test_a_changed_row_does_not_verify_and_null_is_not_empty(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["", None, "-", "1:-", "a"])]
    docs = spark.createDataFrame(rows, corpus.DOCUMENTS)
    leaves = [row.leaf for row in merkle.manifest(docs).collect()]
    assert len(set(leaves)) == len(rows)
    claim = merkle.leaf_hash(*[docs[name] for name in FIELDS[:-1]], docs["lang"])
    assert not any(row.verified for row in merkle.verified(merkle.manifest(docs, claim)).collect())
    assert all(row.verified for row in merkle.verified(merkle.manifest(docs)).collect())


def test_no_rows(spark):
    docs = corpus.empty(spark)
    assert merkle.manifest(docs).count() == 0 and not found(docs)
