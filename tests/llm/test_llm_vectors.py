import math

import corpus
import numpy as np
import pytest

from tenderflow.llm.vectors import Hashing, vector_groups

SCHEMA = "vec_id long, embedding array<{}>, label int, node string, n long, root int"


def planted(kind="float"):
    random = np.random.default_rng(4)
    rows = []
    for i in range(300):
        rows.append((i, random.standard_normal(32), i % 3))
    for center in range(0, 40, 4):
        for j in range(12):
            vector = rows[center][1] + random.standard_normal(32) * 0.15
            rows.append((len(rows), vector * (1 + j), center % 3 if j else None))
    rows += [(len(rows) + j, rows[5][1], 5 % 3) for j in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 32, 1), (n + 3, [-0.0] * 32, 1),
             (n + 4, [math.nan] * 32, 1), (n + 5, [math.inf] + [1.0] * 31, 1),
             (n + 6, [None] + [1.0] * 31, 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], 1),
             (n + 9, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), (None, None, None),
             (n + 10, [1e38] * 32, 2), (n + 11, [1e-38] * 32, 2), (n + 10, [1e38] * 32, 2)]
    return [(*row, "x", 1, 2) for row in rows]


def brute_force(rows, least=0.93):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v) / np.max(np.abs(v)) if usable(v) else None for _, v, *_ in rows]
    vectors = [None if v is None else v / np.linalg.norm(v) for v in vectors]

    def linked(a, b):
        x, y = vectors[a], vectors[b]
        return a != b and x is not None and y is not None and len(x) == len(y) and (
            rows[a][2] is not None and rows[a][2] == rows[b][2] and float(x @ y) >= least
        )

    roots = corpus.roots_of(len(rows), linked)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]]
        smallest = min((d for d in ids if d is not None), default=None)
        links = sum(linked(i, j) for j in range(len(rows)))
        out.append((row[0], links, smallest, row[0] == smallest))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("kind", "block"), [("float", 1024), ("double", 16)])
def test_like_brute_force(spark, kind, block):
    rows = planted()
    frame = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(5)
    assert corpus.rows_of(vector_groups(frame, block=block)) == brute_force(rows)


def test_recall_near_the_threshold():
    assert Hashing().expected_recall(0.93) > 0.99 and Hashing().expected_recall(0.97) > 0.9999
    random = np.random.default_rng(1)
    a = random.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = random.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    found = (Hashing().keys(a) == Hashing().keys(b)).any(axis=1).mean()
    assert found > 0.98


def test_no_rows(spark):
    assert vector_groups(corpus.empty(spark, SCHEMA.format("float"))).count() == 0
