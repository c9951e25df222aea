"""Clusters of candidate nodes dealt to tiles of bounded size, in which every pair that may link meets."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import released

TILE = 1024
TILE_BYTES = 16 << 20
GROUP = ("cluster", "band", "kind", "p", "q")


def dealt(left: DataFrame, payload: str, threshold: Fraction, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``left`` rows (cluster, node, root, n, ...) with the columns ``GROUP``, ``origin``, ``first`` and ``second``.

    In each group the ``first`` rows are to be compared with the ``second`` ones of the same origin, their cluster. A cluster
    that fits a tile (rows, and bytes of ``payload``) goes to a group of several such. The nodes of a larger one are dealt by ``n``, the
    size of their set, to bands of sizes that only link with the same or a neighbouring band, and by hash to tiles within a band.
    """
    columns = [c for c in left.columns if c != "cluster"]
    weight = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.octet_length(payload)) / tile_bytes)).cast("int")
    whole = released(left.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.octet_length(payload)).alias("bytes"), weight.alias("of")))
    small = whole.filter("of <= 1").agg(F.sum("m").alias("m"), F.sum("bytes").alias("bytes")).first()
    pools = 1 + int(max((small.m or 0) / tile, (small.bytes or 0) / tile_bytes))
    all_ = left.join(whole.select("cluster", "of"), "cluster")
    pooled = all_.filter("of <= 1").select(
        F.pmod(F.xxhash64("cluster"), F.lit(pools)).alias("cluster"), *[F.lit(x).alias(c) for c, x in (("band", -1), ("kind", 0), ("p", 0), ("q", 0))],
        F.col("cluster").alias("origin"), *columns, F.lit(True).alias("first"), F.lit(True).alias("second"))

    # A band is a little wider than the ratio, so linked sets are at most one band apart.
    large = all_.filter("of > 1").withColumn("band", F.floor(F.log(F.col("n")) / (-1.001 * math.log(float(threshold)))).cast("int"))
    bands = released(large.groupBy("cluster", "band").agg(weight.alias("tiles")))
    large = large.join(bands, ["cluster", "band"])
    for name, step in (("above", 1), ("below", -1)):
        other = bands.select("cluster", (F.col("band") - step).alias("band"), F.col("tiles").alias(name))
        large = large.join(other, ["cluster", "band"], "left").fillna(0, [name])
    # Two neighbouring bands of one tile each are one group, which also compares the lower band with itself.
    large = large.withColumn("alone", (F.col("tiles") == 1) & (F.col("above") == 1))
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def meet(rows: DataFrame, tiles: str, band, kind: int, p, q, first, second):
        rows = rows.filter(F.col(tiles) > 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(tiles) - 1)))
        return rows.select("cluster", band.alias("band"), F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"),
                           F.col("cluster").alias("origin"), *columns, first.alias("first"), second.alias("second"))

    own, other, band = F.col("own"), F.col("other"), F.col("band")
    inside = meet(large.filter("NOT alone"), "tiles", band, 0, F.least(own, other), F.greatest(own, other), own <= other, own >= other)
    upward = meet(large, "above", band, 1, own, other, F.lit(True), F.col("alone"))
    downward = meet(large, "below", band - 1, 1, other, own, F.lit(False), F.lit(True))
    return pooled.unionByName(inside).unionByName(upward).unionByName(downward)
