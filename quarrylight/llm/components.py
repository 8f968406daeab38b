"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch


def _toward_least(both: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours v as m."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _toward_least(down)
    return found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node of the component.

    Every round is a few joins and sums on edges, which never grow in number; it is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "components")
    clean = lambda df: df.where("u <> v").distinct()
    held = scratch.table(clean(edges.select("u", "v")), "round-0")
    before = None
    for k in range(1, most_rounds + 1):
        held = scratch.table(clean(_small_star(clean(_large_star(held)))), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
