"""Pointer and component work on edge and parent tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TASK_ROWS = 200_000


def _climb_task(pdf: pd.DataFrame) -> pd.DataFrame:
    node, ptr = pdf["node"].to_numpy(), pdf["ptr"].to_numpy()
    order = np.argsort(node)
    at = order[np.searchsorted(node[order], ptr)]
    while True:
        further = at[at]
        if (further == at).all():
            return pd.DataFrame({"node": node, "ptr": node[at]})
        at = further


def climb(pointers: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``node, ptr`` with every ``ptr`` followed to its end, by pointer doubling.

    A node that points to itself is an end; every ``ptr`` has a row of its own.  The number
    of rounds is the logarithm of the longest chain.  A table counted at no more than
    ``task_rows`` is doubled inside one task instead.
    """
    now = cut(pointers.select("node", "ptr"))
    if now.count() <= task_rows:
        return cut(now.groupBy(F.lit(0).alias("g")).applyInPandas(_climb_task, "node long, ptr long"))
    while True:
        hop = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("_next"))
        stepped = cut(now.join(hop, "ptr").select("node", F.col("_next").alias("ptr"), (F.col("_next") != F.col("ptr")).alias("_moved")))
        now = stepped.select("node", "ptr")
        if stepped.filter("_moved").isEmpty():
            return now


def _components_task(pdf: pd.DataFrame) -> pd.DataFrame:
    names, at = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
    left, right = at[: len(pdf)], at[len(pdf) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return pd.DataFrame({"node": names, "root": names[root]})
        root = new


def components(edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``node, root``: the least node reachable over ``a, b`` edges.

    Every round hooks each node to its least neighbour, flattens the hooks by doubling and
    contracts the edges, so a long path takes logarithmically many rounds.  Edges counted
    at no more than ``task_rows`` are settled inside one task.
    """
    links = cut(edges.select("a", "b").filter("a <> b"))
    labels = None
    while True:
        if links.count() <= task_rows:
            flat = links.groupBy(F.lit(0).alias("g")).applyInPandas(_components_task, "node long, root long")
            last = cut(flat.select("node", F.col("root").alias("ptr")))
        else:
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min("b").alias("least"))
            last = climb(near.select(F.col("a").alias("node"), F.least("a", "least").alias("ptr")), task_rows)
        if labels is None:
            labels = last.select("node", F.col("ptr").alias("root"))
        else:
            step = last.select(F.col("node").alias("root"), F.col("ptr").alias("_to"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        labels = cut(labels)
        to_a = last.select(F.col("node").alias("a"), F.col("ptr").alias("_a"))
        to_b = last.select(F.col("node").alias("b"), F.col("ptr").alias("_b"))
        links = cut(links.join(to_a, "a").join(to_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct())
        if links.isEmpty():
            return labels
