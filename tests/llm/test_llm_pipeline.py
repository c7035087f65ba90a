import zlib
from collections import Counter

import corpus
import numpy as np
from test_llm_simhash import plain_print

import corpus_pipeline
from tenderflow.llm import langid, mixing, tokens
from tenderflow.llm.queries import WORD_TOKENIZER, tokenizer_path
from tenderflow.sources.staging import stage


def stages(spark, docs):
    """What each stage is given and what it returns."""
    out = []
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, docs, "/nowhere"), name)
        out.append((docs, after))
        docs = after
    return out


def check_stages(found):
    (raw, known), (_, exact), (_, near), (_, mixed), (_, packed) = found
    for frame in (known, exact, near, mixed):
        assert frame.columns == raw.columns

    filters = langid.learn(raw.where(langid.in_training(raw["doc_id"])))
    rows = raw.collect()
    names, _ = filters.guess([r.text for r in rows])
    kept = [r for r, n in zip(rows, names, strict=True) if n != "und"]
    assert Counter(kept) == Counter(known.collect())

    best = {}
    for r in known.collect():
        key = corpus.fold(r.text)
        rank = -1 if r.doc_id is None else r.doc_id
        best[key] = max(best.get(key, -1), rank)
    rows = exact.collect()
    assert Counter((corpus.fold(r.text), -1 if r.doc_id is None else r.doc_id) for r in rows) == (
        Counter(best.items())
    )

    prints = [plain_print(r.text) for r in rows]
    roots = corpus.roots_of(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    smallest = {}
    for r, root in zip(rows, roots, strict=True):
        number = float("inf") if r.doc_id is None else r.doc_id
        smallest[root] = min(smallest.get(root, float("inf")), number)
    left = [float("inf") if r.doc_id is None else r.doc_id for r in near.collect()]
    assert sorted(left) == sorted(smallest.values())

    copies = Counter()  # several rows can share a doc_id
    for r in mixing.mix_counts(near).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies

    tokenizer = tokens.load_tokenizer(tokenizer_path(WORD_TOKENIZER))
    want = Counter()
    for r in mixed.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want[r.doc_id, piece, start, zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want


def test_stages_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = stages(spark, docs)
    check_stages(found)
    ran = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    plain = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert corpus.rows_of(ran.select(plain)) == corpus.rows_of(found[-1][1].select(plain))


def test_stages_on_awkward_documents(spark):
    docs = stage(corpus.with_clashes(corpus.awkward(spark)), "raw")
    check_stages(stages(spark, docs))


def test_stages_on_no_documents(spark):
    for _, after in stages(spark, corpus.empty(spark)):
        assert after.count() == 0
