"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` (longs); ``root`` is the least node of
    its component.

    Every node points to its least neighbour, pointers are doubled until they end, edges are
    contracted to the ends, and so on until no edge is left: a logarithmic number of joins over
    shrinking tables. All tables of a join are stored first, so that Spark knows their sizes and
    splits a hot end.
    """
    rest = cut(edges.where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct())
    steps = []
    while not rest.isEmpty():
        both = rest.union(rest.select("v", "u")).toDF("u", "v")
        to = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("r")).withColumnRenamed("u", "node"))
        while True:
            nxt = to.select(F.col("node").alias("r"), F.col("r").alias("far"))
            to = cut(to.join(nxt, "r").select("node", F.col("far").alias("r"), (F.col("far") != F.col("r")).alias("moved")))
            if to.where("moved").isEmpty():
                break
        to = to.select("node", "r")
        steps.append(to)
        named = rest.join(to.toDF("u", "ru"), "u").join(to.toDF("v", "rv"), "v")
        rest = cut(named.where("ru <> rv").selectExpr("least(ru, rv) AS u", "greatest(ru, rv) AS v").distinct())
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    found = steps[0]
    for to in steps[1:]:
        found = cut(found.join(to.toDF("r", "far"), "r", "left").select("node", F.coalesce("far", "r").alias("r")))
    return found.withColumnRenamed("r", "root")
