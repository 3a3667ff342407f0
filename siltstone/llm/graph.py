"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation to the smallest neighbour and a join back; no neighbour list is ever
gathered, so a component or a hub of any size stays spread over all tasks.  The edges of a step are
written to the shared folder, which cuts the lineage; those of the step before are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, write_table


def _both_ways(edges: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select(pairs.alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    sides = _both_ways(edges)
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return moved.where("a < b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: orderable, a < b or not) but the roots themselves.

    The root is the smallest node of the component.  Loops (a = b) and nulls are ignored; repeated edges do no harm.
    """
    flat = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    current = write_table(flat, "edges")
    for _ in range(max_rounds):
        before = current
        current = write_table(_small_star(_large_star(before)), "edges")
        seen = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")
        old, new = (x.agg(F.count("*").alias("n"), seen).first() for x in (before, current))
        drop_table(before)
        if tuple(old) == tuple(new):
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
