"""Connected components of an edge table by star contraction, each step a few joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

MAX_ROUNDS = 60


def spanning(u, v, n: int):
    """Root (least index) of each of n nodes under the edges u-v, all numpy arrays; for use inside a task."""
    import numpy as np

    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of edges (columns u, v) that isn't its own root.

    Large-star and small-star rounds until the edges stay as they are. Each round groups by node with
    partial minima and joins the minima back, which the adaptive join splits where a node is hot.
    Ends at once for an empty edge table; loops and repeated edges do no harm.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
