from collections import Counter, defaultdict

import corpus
import pytest

from tenderflow.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), budget=1.5):
    """Targets by sharing again and again, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + share * weight[s] > 2 * sizes[s]}
        for s in open_:
            target[s] += share * weight[s]
        left = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    found = mixing.mix_counts(docs).collect()
    rows = corpus.awkward_rows()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(corpus.WHITE.findall(text or ""))
    target = waterfill(sizes)
    taken, largest = Counter(), defaultdict(int)
    for row in found:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(target[row.source])
        assert row.taken == row.size * row.copies and row.copies in (0, 1, 2)
        taken[row.source] += row.taken
        largest[row.source] = max(largest[row.source], row.size)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * max(largest.values())


def test_even_documents_come_within_one_of_their_target(spark):
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "concat_ws(' ', array_repeat('w', 10)) as text",
        "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source",
    )
    taken, target = Counter(), {}
    for row in mixing.mix_counts(docs).collect():
        taken[row.source] += row.taken
        target[row.source] = row.target
    for source in target:
        assert abs(taken[source] - target[source]) <= 20


def test_reruns_agree_and_rows_are_whole(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    first, second = mixing.mix(docs), mixing.mix(docs.repartition(7))
    assert first.columns == docs.columns
    assert corpus.rows_of(first) == corpus.rows_of(second)
    counts = Counter()
    for row in mixing.mix_counts(docs).collect():
        counts[row.doc_id] += row.copies
    assert Counter(row.doc_id for row in first.collect()) == +counts


def test_no_rows_and_no_words(spark):
    assert mixing.mix_counts(corpus.empty(spark)).count() == 0
    assert mixing.mix(corpus.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 1)], corpus.DOCUMENTS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix_counts(blank).collect()] == [(0, 0, 0)] * 2
