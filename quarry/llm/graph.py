"""Connected components by alternating star contractions, each step written to shared scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.scratch import forget, materialize

#: Up to so many edges, 1 MB of digests, are contracted as one partition, without shuffles: a round is then one job of the driver
#: in place of a dozen exchanges.
FEW = 1 << 15


def _pull(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) becomes (v, lowest neighbour of u); the lowest neighbours are written first, so the join deals
    both sides by key and a hub's rows can be split between tasks."""
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
    return edges.join(low, "u")


def _few_contracted(edges: DataFrame) -> DataFrame:
    """A round of both contractions over few edges."""
    lowest = F.least("u", F.min("v").over(W.partitionBy("u")))
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    large = both.coalesce(1).withColumn("m", lowest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return large.withColumn("m", lowest).select(F.explode(pairs).alias("e")).select("e.*").where("u > v").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """A round of both contractions: edges to higher neighbours, then to lower ones, go to the lowest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _pull(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    large = materialize(large, "large")
    pulled = _pull(large)
    small = (
        pulled.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(pulled.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )
    out = materialize(small, "small")
    forget(large)
    return out


def _mark(edges: DataFrame) -> tuple:
    seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return seen["n"], seen["h"]


def components(links: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """``links``: (a, b) of one orderable type, no nulls; loops and repeats are harmless.

    Returns (node, component): each node that has a link to another node, with the smallest node it reaches.
    An empty table gives an empty table. Rounds with more than ``few`` edges deal them by node.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, edges = edges, materialize(_few_contracted(edges), "small") if mark[0] <= few else _contracted(edges)
        now = _mark(edges)
        forget(before)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
