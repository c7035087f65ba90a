"""Connected components of links, by joins and sums alone."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b); the root is a component's smallest node.

    In each round a node takes the smallest label of its neighbours, a label's own node takes the
    smallest its bearers have seen, and each node takes its label's label.  So labels shorten by
    powers, and a component of any size and shape ends after about the logarithm of its width in
    rounds.  No node's neighbours are gathered; only smallest values are.  Each round is stored,
    which cuts lineage.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    edges = stage(both.distinct().toDF("a", "b"), "links")
    labels = stage(
        edges.groupBy(F.col("a").alias("node"))
        .agg(F.least(F.min("b"), F.first("a")).alias("root")),
        "labels-0",
    )
    for round_ in count(1):
        near = (
            edges.join(labels, edges["b"] == labels["node"])
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        )
        hooks = (
            labels.join(near, "node").groupBy(F.col("root").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        mine, other = labels.alias("mine"), labels.alias("other")
        jumps = mine.join(other, F.col("mine.root") == F.col("other.node")).select(
            F.col("mine.node").alias("node"), F.col("other.root").alias("seen")
        )
        found = near.unionByName(hooks).unionByName(jumps).withColumn("root", F.lit(None))
        last = labels.select("node", F.col("root").alias("seen"), "root")
        after = stage(
            last.unionByName(found).groupBy("node")
            .agg(F.min("seen").alias("root"), F.max("root").alias("was")),
            f"labels-{round_}",
        )
        labels = after.select("node", "root")
        if after.where("root < was").isEmpty():
            return labels


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: each node's smallest node that it reaches."""
    n = len(linked)
    roots = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        near = np.where(reach, roots[None, :], n).min(axis=1)
        near = np.minimum(near, near[near])
        if (near == roots).all():
            return roots
        roots = near
