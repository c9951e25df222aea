"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.ordered import ID_BLOCK, Keys, attach_totals
from sojourn.operators.staging import staged

MAX_ROUNDS = 60


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("blk", F.floor(F.col("v") / ID_BLOCK).cast("bigint"))


def _star(edges: DataFrame, keys: Keys, large: bool) -> DataFrame:
    """One step. A node's neighbours are spread over id blocks, so a hub is never one task."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        hub = attach_totals(_blocked(both), [*keys, "u"], "blk", m=(F.min("v"), F.min))
        hub = hub.withColumn("m", F.least("u", "m")).filter(F.col("v") > F.col("u"))
        moved = hub.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter(F.col("v") < F.col("u"))
        hub = attach_totals(_blocked(down), [*keys, "u"], "blk", m=(F.min("v"), F.min))
        moved = hub.select(*keys, F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame, keys: Keys) -> bool:
    """True when every node points to one root and no root points anywhere (a star per component)."""
    ends = (edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
            .unionByName(edges.select(*keys, F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    nodes = ends.groupBy(*keys, "node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


def components(edges: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, u, v)`` undirected edges to ``(keys, node, root)``; the root is the smallest id of the component."""
    current = staged(edges.filter(F.col("u") != F.col("v"))
                     .select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(current, keys):
            break
        current = staged(_star(_star(current, keys, large=True), keys, large=False))
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    leaves = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)
