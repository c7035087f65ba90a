import random

import corpus
import numpy as np
import pytest

from tenderflow.llm.components import components, local_roots

rng = random.Random(2)
SHAPES = {
    "path": [(i, i + 1) for i in range(60)],
    "shuffled path": (lambda p: list(zip(p, p[1:], strict=False)))(rng.sample(range(60), 60)),
    "star": [(50, i) for i in range(50)],
    "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(55)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    links = SHAPES[shape]
    both = set(links) | {(b, a) for a, b in links}
    roots = corpus.roots_of(100, lambda a, b: (a, b) in both)
    nodes = {n for link in links for n in link}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(n, roots[n]) for n in nodes}
    matrix = np.zeros((100, 100), bool)
    for a, b in both:
        matrix[a, b] = True
    assert local_roots(matrix).tolist() == roots
