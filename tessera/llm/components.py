"""Connected components over link tables, without collecting links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of nodes 0 to n - 1 by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = np.minimum(new[label], new)
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the smallest node reachable.

    Every step takes the smallest label among a node's neighbours and then
    jumps to the label's own label, so paths halve and steps grow with the
    logarithm of a component's diameter. Grouping is a pre-aggregated minimum;
    a hub's rows are never brought together. Labels only fall and each round
    lowers one at least, so the loop ends.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    edges = materialise(both.where("a <> b").distinct(), "cc-edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "cc-labels")
    if labels.isEmpty():
        return labels
    while True:
        near = (
            edges.hint("merge").join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.hint("merge").join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        stepped = materialise(
            lower.hint("merge").join(jump, "to", "left").select("node", F.least("to", "next").alias("label"), "old"), "cc-labels"
        )
        done = stepped.where("label <> old").isEmpty()
        discard(labels)
        labels = stepped.select("node", "label")
        if done:
            discard(edges)
            return labels
