"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).head()
    return row["n"], row["h"] or 0


def _rewired(arcs: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Point the neighbours ``v`` of each ``u`` (and ``u``) at the smallest of them. Both sides are written tables, so
    a node that has a third of all arcs is split by the join."""
    least = written(arcs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u")))
    moved = arcs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved, least


def star_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge (``u, v``, not null): the root is the smallest node reachable."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large, _ = _rewired(both, F.col("v") > F.col("u"))
        large = written(large.distinct())
        small, least = _rewired(large, F.lit(True))
        small = small.unionByName(least.select("u", F.col("least").alias("v"))).filter("u <> v")
        edges = written(small.distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
