"""Connected components of an edge table, by smallest label, with pointer jumping."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that links (i, j) reach, for each of n indices in memory."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex in `edges` (a, b); component is the smallest id that links reach.

    Each round takes the smallest label among neighbours and then the label of that label.  Nothing but a count goes to
    the driver.  Minima are combined before the shuffle and joins have one row per key on one side, so a vertex with
    very many neighbours can be split.  Nulls and loops are ignored; an empty table gives no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    labels = cut(dealt_anew(labels.select("id", F.least("id", "least").alias("component"))))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("further"))
        hooked = hooked.join(dealt_anew(jump), "component", "left").select("id", "was", F.least("component", "further").alias("component"))
        hooked = cut(dealt_anew(hooked))
        labels = hooked.select("id", "component")
        if hooked.where("was <> component").isEmpty():
            return labels
