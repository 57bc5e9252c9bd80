"""Connected components over edge tables, by repeated joins on materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import Workspace

#: Up to so many edges (they never grow), a number for each node is sent to every task.
FEW = 500_000


def components(edges: DataFrame, ws: Workspace, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the component's smallest node.

    Alternates two star steps: every node's larger neighbours are tied to its smallest neighbour, then every
    node's smaller neighbours are. Each round writes its edges to the shared folder and drops those before,
    so lineage stays short and a lost executor costs a re-read. The number of edges never grows. A node with
    very many neighbours is folded by an aggregation (its minimum), which is sent to every task where there are
    few edges; else it is written before it is joined, so that the join has plain shuffles under it, which Spark
    can split. The number of rounds follows the logarithm of the longest path.
    """
    now, before = ws.save(_distinct(edges), "edges-0"), None
    few = now.count() <= FEW
    folded = lambda df, name: F.broadcast(df) if few else ws.save(df, name)
    for k in range(1, most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = folded(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"least-{k}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(_distinct(large), f"large-{k}")
        small = folded(large.groupBy("u").agg(F.min("v").alias("m")), f"small-{k}")  # u > v here: every v is smaller
        tied = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = ws.save(_distinct(tied.unionByName(small.withColumnRenamed("m", "v"))), f"edges-{k}")
        ws.drop(f"edges-{k - 1}", f"least-{k}", f"large-{k}", f"small-{k}")
        # a set of edges is done when it is a set of stars; its checksum then stays
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
