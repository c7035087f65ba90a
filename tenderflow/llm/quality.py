"""Document quality by hierarchical empirical Bayes.

A linear classifier on what kinds of characters follow each other gives each document's evidence,
as log odds without a prior.  The prior comes from where it was found: all documents, labelled ones
by their label and others by their expected quality, are summed by host and by path within a host.
A host's rate is shrunk toward the rate of all, a path's toward its host's, by strengths estimated
from how much rates differ beyond chance, so sparse sites count little.  A document's own share is
taken out of both before its prior is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage

FITTED_ROWS = 8000  # most labelled documents that the classifier is fitted on
STEPS = 400
PENALTY = 1e-3
#: Characters that are a kind of their own; all other marks are one kind.
MARKS = " \n.,!?'\"-:;()|%$#&*@/=<>_"
LOWER, UPPER, LETTER, DIGIT, MARK = range(len(MARKS), len(MARKS) + 5)
KINDS = len(MARKS) + 5
CHUNK = 1 << 20


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = np.full(0x110000, MARK, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            kinds[code] = UPPER if char.isupper() else LOWER if char.islower() else LETTER
        elif char.isdigit():
            kinds[code] = DIGIT
    for number, char in enumerate(MARKS):
        kinds[ord(char)] = number
    return kinds


def features(text: str | None) -> np.ndarray:
    """Shares of the pairs of neighbouring kinds in a whole text, as square roots, and the
    logarithm of its length."""
    text = text or ""
    pairs = np.zeros(KINDS * KINDS)
    for start in range(0, len(text), CHUNK):
        codes = np.frombuffer(
            text[start:start + CHUNK + 1].encode("utf-32-le", "replace"), np.uint32
        )
        kinds = _kinds()[codes]
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=len(pairs))
    share = np.sqrt(pairs / max(1, len(text) - 1))
    return np.append(share, math.log1p(len(text)) / 10).astype(np.float32)


@dataclass(frozen=True)
class Classifier:
    """Weights, and the log odds of the documents it was fitted on."""

    weights: np.ndarray
    bias: float
    base: float

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log odds that the texts add to any prior."""
        if not len(self.weights):
            return np.zeros(len(texts))
        return np.array([float(features(t) @ self.weights) for t in texts]) + self.bias - self.base


def fit(found: np.ndarray, good: np.ndarray) -> Classifier:
    """Logistic regression with a penalty, by accelerated gradient steps."""
    rate = (good.sum() + 1) / (len(good) + 2)
    base = math.log(rate / (1 - rate))
    if good.min(initial=1) == good.max(initial=0) or not len(good):
        return Classifier(np.zeros(0), 0.0, base)
    mean, spread = found.mean(axis=0), found.std(axis=0) + 1e-3
    scaled = np.column_stack([(found - mean) / spread, np.ones(len(found))])
    step = 4 / (np.linalg.norm(scaled, 2) ** 2 / len(scaled) + 4 * PENALTY)
    weights = ahead = np.zeros(scaled.shape[1])
    for k in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(scaled @ ahead, -30, 30))) - good
        new = ahead - step * (scaled.T @ error / len(good) + PENALTY * ahead)
        weights, ahead = new, new + k / (k + 3) * (new - weights)
    plain = weights[:-1] / spread
    return Classifier(plain, float(weights[-1] - plain @ mean), base)


def fit_on(docs: DataFrame, labels: DataFrame, most: int = FITTED_ROWS) -> Classifier:
    """A classifier of ``docs`` (doc_id, text) that ``labels`` (doc_id, good) has; of more than
    ``most`` rows those whose hashes are smallest are taken, on every run the same.  Of several
    rows with one doc_id the one with the smallest hash of its text counts, once."""

    @F.pandas_udf(T.BinaryType())
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: features(text).tobytes())

    chosen = stage(labels.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most), "chosen")
    joined = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        "doc_id", "good", F.struct(F.xxhash64("text").alias("h"), measured("text").alias("found"))
        .alias("row"),
    )
    rows = (
        joined.groupBy("doc_id", "good").agg(F.min("row").alias("row"))
        .select("good", "row.found").toArrow()
    )
    found = [np.frombuffer(row, np.float32) for row in rows.column("found").to_pylist()]
    found = np.array(found or np.zeros((0, KINDS * KINDS + 1)), np.float64)
    return fit(found, np.array(rows.column("good").to_pylist(), np.float64))


def _strength(groups: DataFrame, center: Column) -> float:
    """How many documents a prior weighs, from sums (n, good) by group around ``center``: the
    rates' variance beyond what chance gives rates of n documents."""
    rate = F.col("good") / F.col("n")
    row = groups.select(
        F.sum(F.col("n") * F.pow(rate - center, 2)), F.sum(center * (1 - center)),
        F.sum("n"), F.sum(F.col("n") * F.col("n")),
        F.sum(F.col("n") * center * (1 - center)),
    ).first()
    spread, chance, n, squares, inside = [float(value or 0) for value in row]
    if not n or not inside:
        return 1.0
    excess = (spread - chance) / max(n - squares / n, 1e-9)
    return min(max((inside / n) / max(excess, 1e-9) - 1, 1.0), 1e6)


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def quality(
    docs: DataFrame, labels: DataFrame, host: str = "host", path: str = "path",
    most: int = FITTED_ROWS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ``host``, ``path``): doc_id, evidence,
    host_rate, path_rate, quality (a probability) and kept, that it is at least a half.

    ``labels`` (doc_id, good: 0 or 1) has one row or none for a document; null labels count as
    none, and of several the mean.  Null and empty texts are texts without pairs.  Null hosts and
    paths are a host and a path of their own.  Without labels of both kinds the evidence is 0.
    Texts are read whole, however long.  Repeated rows each give a row; no rows give none; other
    columns are not read.
    """
    ship_code(docs.sparkSession)
    given = labels.where("good is not null and doc_id is not null").groupBy("doc_id").agg(
        F.avg("good").alias("good")
    )
    given = stage(given, "given")
    classifier = fit_on(docs, given.select("doc_id", F.round("good").alias("good")), most)
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf(T.DoubleType())
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(sent.value.evidence(batch.tolist()))

    scored = stage(
        docs.select(
            "doc_id", F.col(host).alias("host"), F.col(path).alias("path"),
            evidence(docs["text"]).alias("evidence"),
        ),
        "scored",
    )
    base = F.lit(classifier.base)
    expected = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    shared = scored.join(given, "doc_id", "left").withColumn(
        "share", F.coalesce("good", expected)
    )
    shared = stage(shared.drop("good"), "shared")
    sums = [F.count("*").alias("n"), F.sum("share").alias("good")]
    paths = stage(shared.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count("*").alias("paths")
    )
    total = hosts.agg(F.sum("host_good"), F.sum("host_n")).first()
    rate = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    host_k = _strength(
        hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), F.lit(rate)
    )
    host_rate = (F.col("host_good") + host_k * rate) / (F.col("host_n") + host_k)
    sites = stage(
        paths.join(
            hosts.withColumnRenamed("host", "its"), F.col("host").eqNullSafe(F.col("its"))
        ).withColumn("center", host_rate).drop("its"),
        "sites",
    )
    path_k = _strength(sites, F.col("center"))
    found = sites.select(
        F.col("host").alias("its_host"), F.col("path").alias("its_path"), "n", "good", "host_n",
        "host_good",
    )
    # without the document itself
    host_rate = (F.col("host_good") - F.col("share") + host_k * rate) / (
        F.col("host_n") - 1 + host_k
    )
    path_rate = (F.col("good") - F.col("share") + path_k * F.col("host_rate")) / (
        F.col("n") - 1 + path_k
    )
    safe = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        shared.join(
            found,
            F.col("host").eqNullSafe(F.col("its_host"))
            & F.col("path").eqNullSafe(F.col("its_path")),
        )
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(safe)))))
        .withColumn("kept", F.col("quality") >= 0.5)
        .select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")
    )
