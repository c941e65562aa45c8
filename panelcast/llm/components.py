"""Connected components by alternating large and small stars.

Each step replaces edges with edges to the least neighbour; components and their least member stay the
same. It ends when every edge leads to the least member. Steps are aggregations with map-side combine
and joins, cut by tables in the shared folder, and their number grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.stage import keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return moved.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v")


#: Edges that one task writes.
TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node and component (least node) of every node of edges (u, v) that isn't itself the least.

    Edges to oneself and those with a null end count for nothing; repeated edges count once.
    """
    now = keep(edges.select("u", "v").where("u <> v"))
    count = now.count()
    while count:
        # The number of edges never grows much: it tells how many tasks the next table needs.
        now = keep(_small_star(_large_star(now)).distinct().coalesce(count // TASK_EDGES + 1))
        count, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if count == nodes and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # each node has one edge, to a node that has none
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
