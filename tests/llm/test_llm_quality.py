import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderflow.llm import quality

ROOT = "/root/testdata/sf0.01"
LABELS = "doc_id long, good int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").selectExpr("doc_id", "quality as good")
    held = F.col("doc_id") % 5 == 0
    found = quality.quality(docs, labels.where(~held), "source", "lang")
    rows = found.join(labels.where(held), "doc_id").collect()
    assert len(rows) > 60
    assert sum(r.kept == (r.good == 1) for r in rows) / len(rows) >= 0.95


def test_rates_are_shrunk_posteriors(spark):
    """Without evidence, as all texts are equal, rates follow from the labels alone."""
    random = np.random.default_rng(8)
    rows, labels = [], []
    for site in range(40):
        rate = 0.9 if site % 2 else 0.2
        for i in range(40 if site < 38 else 1):
            rows.append((len(rows), "same text", f"host{site}", f"p{i % 2}"))
            labels.append((len(labels), int(random.random() < rate)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    found = {
        r.doc_id: r for r in
        quality.quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    }
    overall = np.mean([good for _, good in labels])
    for number, _, host, _ in rows:
        row, site = found[number], int(host[4:])
        assert abs(row.evidence) < 0.01
        if site < 38:
            assert abs(row.host_rate - (0.9 if site % 2 else 0.2)) < 0.25
        else:  # nothing but the document itself
            assert row.host_rate == pytest.approx(overall, abs=0.01)
            assert row.path_rate == pytest.approx(row.host_rate)


def test_strength_against_known_spread(spark):
    random = np.random.default_rng(5)
    for strength in (4.0, 40.0):
        rates = random.beta(0.6 * strength, 0.4 * strength, 3000)
        groups = [(30, float(random.binomial(30, rate))) for rate in rates]
        frame = spark.createDataFrame(groups, "n long, good double")
        assert quality._strength(frame, F.lit(0.6)) == pytest.approx(strength, rel=0.25)


def test_features_cover_whole_texts(monkeypatch):
    text = corpus.awkward_rows()[5][1]
    whole = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 1000)
    assert np.allclose(quality.features(text), whole)
    assert quality.features(None).sum() == quality.features("").sum() == 0


def test_awkward_documents(spark):
    docs = corpus.with_clashes(corpus.awkward(spark)).withColumn("good", F.lit("x"))
    labels = [(i, i % 2) for i in range(20, 60)] + [(None, 1), (21, None), (20, 1), (9999, 0)]
    frame = spark.createDataFrame(labels, LABELS)
    found = quality.quality(docs, frame, "source", "lang").collect()
    assert len(found) == len(corpus.awkward_rows())
    assert all(0 <= r.quality <= 1 and r.kept == (r.quality >= 0.5) for r in found)
    assert quality.quality(corpus.empty(spark), frame, "source", "lang").count() == 0
    none = quality.quality(docs, corpus.empty(spark, LABELS), "source", "lang").collect()
    assert len(none) == len(found) and all(r.evidence == 0 for r in none)


def test_repeated_rows_are_fitted_once(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda found, good: fitted.append((found, good)))
    once = [(i, "Some words. " * (i + 1)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], LABELS)
    again = [(3, once[3][1]), (4, None), (4, "other text 123")] * 50
    for rows in (once, once + [r for r in again if r[0] == 3], once + again, again[::-1] + once):
        quality.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    for found, good in fitted:
        assert len(found) == 20 and sorted(good) == [0] * 10 + [1] * 10
    sets = [sorted(map(tuple, found)) for found, _ in fitted]
    assert sets[0] == sets[1] and sets[2] == sets[3]


def plain_features(text):
    """Shares of pairs of kinds, one pair at a time."""
    text = text or ""
    pairs = np.zeros(quality.KINDS * quality.KINDS)

    def kind(char):
        if char in quality.MARKS:
            return quality.MARKS.index(char)
        if char.isalpha():
            return quality.UPPER if char.isupper() else (
                quality.LOWER if char.islower() else quality.LETTER)
        return quality.DIGIT if char.isdigit() else quality.MARK

    for a, b in zip(text, text[1:]):
        pairs[kind(a) * quality.KINDS + kind(b)] += 1
    return np.append(np.sqrt(pairs / max(1, len(text) - 1)), np.log1p(len(text)) / 10)


def plain_strength(groups):
    """Of (n, good, center)."""
    n = sum(g[0] for g in groups)
    spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups)
    chance = sum(g[2] * (1 - g[2]) for g in groups)
    squares = sum(g[0] ** 2 for g in groups)
    inside = sum(g[0] * g[2] * (1 - g[2]) for g in groups)
    excess = (spread - chance) / max(n - squares / n, 1e-9)
    return min(max((inside / n) / max(excess, 1e-9) - 1, 1.0), 1e6)


def plain_quality(rows, labels):
    """(evidence, host rate, path rate, quality) of each row, group by group."""
    given = {}
    for doc_id, good in labels:
        if doc_id is not None and good is not None:
            given.setdefault(doc_id, []).append(good)
    given = {doc_id: np.mean(good) for doc_id, good in given.items()}
    found = [plain_features(r[1]) for r in rows]
    fitted = {}
    for row, one in zip(rows, found, strict=True):
        if row[0] in given:
            fitted[row[0]] = (one, int(given[row[0]] + 0.5))
    known = [fitted[doc_id] for doc_id in sorted(fitted)]
    classifier = quality.fit(np.array([one for one, _ in known]), np.array([g for _, g in known], float))
    evidence = [one @ classifier.weights + classifier.bias - classifier.base for one in found]
    share = [
        given.get(r[0], 1 / (1 + np.exp(-(e + classifier.base))))
        for r, e in zip(rows, evidence, strict=True)
    ]
    hosts, paths = {}, {}
    for r, s in zip(rows, share, strict=True):
        for sums, key in ((hosts, r[2]), (paths, (r[2], r[3]))):
            n, good = sums.get(key, (0, 0.0))
            sums[key] = n + 1, good + s
    rate = (sum(share) + 1) / (len(rows) + 2)
    host_k = plain_strength([(n, good, rate) for n, good in hosts.values()])
    centers = {h: (good + host_k * rate) / (n + host_k) for h, (n, good) in hosts.items()}
    path_k = plain_strength([(n, good, centers[key[0]]) for key, (n, good) in paths.items()])
    out = []
    for r, s, e in zip(rows, share, evidence, strict=True):
        n, good = hosts[r[2]]
        host = (good - s + host_k * rate) / (n - 1 + host_k)
        n, good = paths[r[2], r[3]]
        path = (good - s + path_k * host) / (n - 1 + path_k)
        safe = min(max(path, 1e-6), 1 - 1e-6)
        out.append((e, host, path, 1 / (1 + np.exp(-(e + np.log(safe / (1 - safe)))))))
    return out


def test_every_row_against_the_plain_formula(spark):
    random = np.random.default_rng(12)
    words = ["the", "of", "river", "Stone", "Ève", "12", "walks"]
    rows, labels = [], []
    for i in range(240):
        bad = random.random() < (0.7 if i % 4 else 0.2)
        mark = "&&& $$$" if bad else " "
        text = mark.join(random.choice(words, random.integers(1, 40)))
        host = [None, "a", "b", "c", "d"][i % 5]
        rows.append((i, text, host, [None, "x", "y"][i % 3]))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(500, None, "a", "x"), (501, "", None, None), (502, "lone", "z", "z"), (None, "q", "a", "x")]
    labels += [(0, None), (None, 1), (1, 1), (1, 0), (1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    docs = docs.withColumns({"good": F.lit("x"), "n": F.lit("x"), "share": F.lit("x")})
    found = quality.quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = {row[0]: one for row, one in zip(rows, plain_quality(rows, labels), strict=True)}
    assert len(found) == len(rows)
    for row in found:
        got = (row.evidence, row.host_rate, row.path_rate, row.quality)
        assert got == pytest.approx(want[row.doc_id], rel=2e-3, abs=2e-3)
        assert row.kept == (row.quality >= 0.5)
