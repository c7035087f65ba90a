import zlib
from collections import Counter

import corpus
import numpy as np
from pyspark.sql import functions as F

from tenderflow.llm import langid

TABLES = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(text):
    letters = [
        (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in text or ""
    ]
    padded = ["\0", *letters, "\0"]
    return [
        ord(a) << 42 | ord(b) << 21 | ord(c)
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False) if b != "\0"
    ]


def test_grams_of_cut_texts(monkeypatch):
    texts = [row[1] for row in corpus.awkward_rows()]
    for size in (langid.CHUNK, 3):
        monkeypatch.setattr(langid, "CHUNK", size)
        some = [t for t in texts if size > 3 or len(t or "") < 500]
        found = {i: [] for i in range(len(some))}
        for grams, owners in langid.chunks(some):
            for gram, owner in zip(grams.tolist(), owners.tolist(), strict=True):
                found[owner].append(gram)
        assert all(found[i] == plain_grams(text) for i, text in enumerate(some))


def test_filters_hold_what_they_were_given_and_little_else(spark):
    docs = spark.read.parquet(TABLES)
    filters = langid.learn(docs)
    assert filters.languages == ["de", "en", "es", "fr"]
    counts = {}
    for text, lang in docs.select("text", "lang").collect():
        own = counts.setdefault(lang, {})
        for gram in plain_grams(text):
            own[gram] = own.get(gram, 0) + 1
    rates = {
        lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()
    }
    every = np.array(sorted({g for own in rates.values() for g in own}))
    masks = filters.look_up(every)[:, 0]
    wrong = 0
    for number, lang in enumerate(filters.languages):
        for gram, mask in zip(every.tolist(), masks.tolist(), strict=True):
            rate = rates[lang].get(gram, 0)
            top = max(own.get(gram, 0) for own in rates.values())
            belongs = rate >= langid.LEAST_RATE and rate >= langid.LEAST_SHARE * top
            assert mask >> number & 1 or not belongs
            wrong += bool(mask >> number & 1) and not belongs
    assert wrong <= 0.01 * len(every) * len(filters.languages)
    assert (filters.chance < 0.01).all()


def plain_guess(rows):
    """(lang_pred, score) of each row by exact sets of n-grams instead of filters."""
    counts = {}
    for doc_id, text, lang, *_ in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5:
            own = counts.setdefault(lang, Counter())
            own.update(plain_grams(text))
    counts = {lang: own for lang, own in counts.items() if own}
    rates = {lang: {g: n / own.total() for g, n in own.items()} for lang, own in counts.items()}
    tops = {}
    for own in rates.values():
        for gram, rate in own.items():
            tops[gram] = max(tops.get(gram, 0), rate)
    sets = {
        lang: {g for g, rate in own.items()
               if rate >= langid.LEAST_RATE and rate >= langid.LEAST_SHARE * tops[g]}
        for lang, own in rates.items()
    }
    letters = {lang: Counter() for lang in counts}
    for lang, own in counts.items():
        for gram, n in own.items():
            letters[lang][gram & langid.ALONE] += n / own.total()
    alone = {
        lang: {g for g, rate in own.items()
               if rate >= langid.LEAST_SHARE * max(other[g] for other in letters.values())}
        for lang, own in letters.items()
    }
    common = max(sorted(counts), key=lambda lang: counts[lang].total())
    out = []
    for _, text, *_ in rows:
        grams, worth = plain_grams(text), 1
        hits = {lang: sum(g in held for g in grams) for lang, held in sorted(sets.items())}
        if not max(hits.values()):
            worth = langid.LETTER_WORTH
            hits = {
                lang: sum(g & langid.ALONE in held for g in grams)
                for lang, held in sorted(alone.items())
            }
        best = max(hits, key=hits.get) if max(hits.values()) else common
        ranked = sorted(hits.values())
        clear = len(ranked) < 2 or ranked[-1] - ranked[-2] > 0.02 * len(grams)
        out.append((best, worth * hits[best] / len(grams), clear) if grams else ("und", 0.0, True))
    return out


def test_predictions_against_exact_sets(spark):
    """Filters add only their false positives, which are taken off again on the average."""
    docs = spark.read.parquet(TABLES).select("doc_id", "text", "lang", "source", "n_chars")
    han = "".join(map(chr, range(0x4E00, 0x5E00)))  # a language with a large alphabet
    random = np.random.default_rng(6)
    more = [
        (10_000 + i, "".join(random.choice(list(han), 300)), "zh", "s", 300) for i in range(120)
    ]
    rows = [tuple(r) for r in docs.collect()] + more
    frame = spark.createDataFrame(rows, corpus.DOCUMENTS)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame).collect()}
    wrong = 0
    for row, (lang, score, clear) in zip(rows, plain_guess(rows), strict=True):
        got, got_score = found[row[0]]
        wrong += got != lang and clear
        assert abs(got_score - score) < 0.02 or got != lang
    assert wrong == 0
    assert sum(found[r[0]][0] == "zh" for r in more) == len(more)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(TABLES)
    found = langid.identify(docs.withColumn("guess", F.lit("x")))
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_reads_neither_lang_nor_source(spark):
    docs = spark.read.parquet(TABLES)
    blind = docs.withColumns({
        "lang": F.when(langid.in_training(F.col("doc_id")), F.col("lang")), "source": F.lit(None),
    })
    assert corpus.rows_of(langid.identify(docs)) == corpus.rows_of(langid.identify(blind))


def test_awkward_documents(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    found = {}
    for row in langid.identify(docs).collect():
        found[row.doc_id] = row
    assert len(langid.identify(docs).collect()) == len(corpus.awkward_rows())
    for number in (3, 4, 5, 10):
        assert (found[number].lang_pred, found[number].score) == ("und", 0.0)
    assert all(found[i].lang_pred in ("en", "fr", "de") for i in (1, 2, 6, 7, 8, 11, 12, None))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}
    assert langid.identify(corpus.empty(spark)).count() == 0
    assert langid.keep_identified(corpus.empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_texts_with_rare_letters_only_are_kept(spark):
    rows = [*corpus.awkward_rows(), (500, "жщю ыэя", None, "a", 7), (501, "99 !", None, "a", 4)]
    docs = spark.createDataFrame(rows, corpus.DOCUMENTS)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert found[500] == ("en", 0.0) and found[501] == ("und", 0.0)
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert kept == {i for i, (lang, _) in found.items() if lang != "und"} and 500 in kept


def test_counts_are_passed_on_in_time(spark, monkeypatch):
    docs = corpus.awkward(spark)
    whole = corpus.rows_of(langid.count_grams(docs))
    monkeypatch.setattr(langid, "MOST_SEEN", 10)
    assert corpus.rows_of(langid.count_grams(docs)) == whole


def test_names_of_languages_are_taken_as_they_are(spark):
    rows = [(i, "the tree " * 3, "en\0" if i % 2 else "a long name " * 50, "s", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, corpus.DOCUMENTS)
    assert {r.lang for r in langid.count_grams(docs).collect()} == {r[2] for r in rows}


def test_many_languages(spark):
    rows = [(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q " * 9, f"l{i:03}", "s", 1) for i in range(150)]
    docs = spark.createDataFrame([r for r in rows for _ in (0, 1)], corpus.DOCUMENTS)
    filters = langid.learn(docs)
    assert filters.masks.shape[1] == 3
    names, _ = filters.guess([r[1] for r in rows])
    assert names == [r[2] for r in rows]
