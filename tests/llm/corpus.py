"""Small documents with every awkward case, and brute-force versions to compare with."""

from __future__ import annotations

import random
import re
import string

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ["row", "whole", "h", "body", "print", "size", "shuffle", "bucket", "key", "n", "best",
            "copies", "guess", "taken", "root", "label", "slice"]
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["the", "of", "and", "house", "Tree", "river", "stone", "green", "walks", "Ève", "ÉVE"]
    long = " ".join(rng.choice(words) + str(i % 97) for i in range(40_000))
    rows = [
        (1, "The house of the tree", "en", "a", 21), (2, "the HOUSE of the tree", "en", "a", 21),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", "fr", None, 4),
        (6, long, "en", "a", len(long)), (7, long, None, "b", len(long)),
        (8, "Ève", "fr", "b", 3), (9, "ève", "fr", "b", 3), (10, "12 34 ... !", "de", "c", 11),
        (11, "one  two three\x00four <|endoftext|> ΑΣ. İ é́", "fr", "c", 30),
        (None, "no number", "en", "c", 9), (None, "no number", "en", "c", 9),
        (12, "same row", "en", "d", 8), (12, "same row", "en", "d", 8),
        (12, "same number, other text", "en", "d", 23),
    ]
    for i in range(20, 80):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text, rng.choice(["en", "fr", "de"]), rng.choice("abcd"), len(text)))
    rows += [(i + 100, rows[16 + i % 40][1], "en", "a", 1) for i in range(60)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("x") for name in CLASHING})


def empty(spark, schema: str = DOCUMENTS):
    return spark.createDataFrame([], schema)


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def fold(text: str | None) -> str:
    return (text or "").translate(FOLD)


def roots_of(n: int, linked) -> list[int]:
    """Each node's smallest reachable node, by the plainest search."""
    root = list(range(n))
    for start in range(n):
        if root[start] == start:
            waiting = [start]
            while waiting:
                a = waiting.pop()
                for b in range(n):
                    if b > start and root[b] == b and linked(a, b):
                        root[b] = start
                        waiting.append(b)
    return root
