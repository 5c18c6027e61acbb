"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


#: Edges of an intermediate file.
EDGES_A_FILE = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that an edge (u, v: long) touches; the component is its smallest node.

    Loops and repeated edges are ignored, null ends too. No edge gives no row. Each round is written
    to the shared folder, so that the plan stays short and a lost executor costs one round.
    """
    with scratch(edges.sparkSession) as keep:
        edges = materialize(edges.where("u <> v").select("u", "v").distinct(), label)
        before = _digest(edges)
        files = -(-before[0] // EDGES_A_FILE) or 1
        for _ in range(max_rounds if before[0] else 0):
            edges = materialize(_small_star(_large_star(edges)), label, files)
            now = _digest(edges)
            if now == before:
                break
            before = now
        else:
            if before[0]:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        keep(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
