"""Connected components of a graph given as a table of links, by large-star and small-star rounds.

Every node keeps only links towards smaller neighbours' minima until all hang on their component's
smallest node (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Minima are
partial aggregates, and the join that hands them back may be split by the skew join, so that a node
with very many links is no bottleneck. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, remove, saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of a task's own links, without those that are their own: at most one link a node is left."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (columns a, b); component is the smallest node reachable.

    Nodes without links are not in the result. Loops, repeated links and empty tables are allowed; null ends are left out.
    """
    spark, path = links.sparkSession, folder(links.sparkSession)
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before, turn = saved(ends, f"{path}/0"), None, 0
    while True:
        turn += 1
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        star = saved(small.select("x.u", "x.v").where("u <> v").distinct(), f"{path}/{turn}")
        remove(spark, f"{path}/{turn - 1}")
        now = star.agg(F.count("*"), F.countDistinct("u"), F.expr("sum(cast(xxhash64(u, v) AS decimal(20,0)))")).first()
        if now == before or (now[0] == now[1] and star.join(star.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
