"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_since, kept, made_so_far


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: bigint), the component being its smallest node.

    Each round hooks neighbours to the smallest one they know (large star), then collapses chains (small star),
    as joins and minima over the edge table: no group, component or edge list is collected anywhere, and each
    round is written to the shared folder and removed when the next one is. A hot centre is a skewed join between two stored tables, which
    adaptive execution splits.
    """
    step = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    begun = made_so_far()
    step, mark = kept(step, "edges"), None
    for _ in range(rounds):
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low").withColumnRenamed("u", "v")
        large = kept(step.join(low, "v").select("u", F.col("low").alias("v")).where("u <> v").distinct(), "large")
        low = kept(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").union(low.select("u", "low")).distinct()
        step = kept(small, "edges")
        forget_since(step.sparkSession, begun, step)
        now = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            return step.select(F.col("u").alias("node"), F.col("v").alias("component")).union(step.select("v", "v").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the label classes of a[i] and b[i]; labels are the smallest index of their class."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label
