"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    ``edges`` has long columns u and v. Nodes without a link are not in the
    result. Every round is written to the shared folder, so a lost executor
    repeats one round at most. Grouping uses min() alone, so a node with very
    many links is combined map-side and its join is split by adaptive
    execution; nothing is collected.
    """
    spark = edges.sparkSession
    now = materialize(spark, edges.where(F.col("u") != F.col("v")).distinct(), name)
    sign = None
    for _ in range(max_rounds):
        now = materialize(spark, _small_star(_large_star(now)), name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct())
