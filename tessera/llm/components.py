"""Connected components of a graph held in a DataFrame, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch


def components(s: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (u, v): comp is the least node it reaches.

    Each round, every node hooks onto its least neighbour if that is less, chains are cut short until they are stars,
    and edges move to the stars' centres. Rounds are logarithmic for chains and one for stars; only integers move.
    """
    edges = s.write(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    out = None
    while edges.limit(1).count():
        parent = s.write(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("p")))
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = s.write(parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            s.drop(parent)
            more = jumped.where("moved").limit(1).count()
            parent = jumped.select("node", "p")
            parent._scratch_path = jumped._scratch_path
            if not more:
                break
        if out is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
            new = s.write(nodes.join(parent, "node", "left").select("node", F.coalesce("p", "node").alias("comp")))
        else:
            new = s.write(out.join(parent.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
            s.drop(out)
        pu, pv = parent.toDF("u", "pu"), parent.toDF("v", "pv")
        moved = edges.join(pu, "u", "left").join(pv, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        then = s.write(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
        s.drop(edges, parent)
        edges, out = then, new
    return out if out is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
