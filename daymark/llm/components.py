"""Connected components of an edge table, in alternating star contractions.

Each round points every node's larger neighbours at the smallest node of its neighbourhood, then
does the same with the smaller ones. Node neighbourhoods are only reduced with ``min``, never
gathered. Rounds are written to the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self-loops and null ends are ignored; repeated edges count once.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"),
                     F.col(src).alias("_a"), F.col(dst).alias("_b"))
        .filter("_a IS NOT NULL AND _b IS NOT NULL AND u <> v").select("u", "v").distinct())
    pairs = materialize(pairs, "component-edges")
    signature = _signature(pairs)
    while signature[0]:
        pairs = materialize(_small_star(_large_star(pairs)), "component-edges")
        before, signature = signature, _signature(pairs)
        if before == signature:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(pairs: DataFrame) -> tuple:
    """Row count and an order-free hash sum; equal when a round changed nothing."""
    row = pairs.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of its neighbourhood."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    upward = pairs.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return (upward.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
