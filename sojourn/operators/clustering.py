"""Density clustering on the sphere: cell joins for neighbours, grid contraction for clusters.

A cell's diagonal is at most eps, so its core points are one connected node, and a cell with enough weight is all core. No pairs
inside a cell are formed, whatever its points weigh, and pairs of cells are settled by a descent through boxes
(``operators/boxes.py``): to count what lies around the points of thin cells, to find one witness between two core cells, and to
find the clusters that border points touch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import CLUSTER_EPS_M, CLUSTER_MIN_PTS, EARTH_RADIUS_M
from sojourn.functions import geo
from sojourn.operators.boxes import BOX, BOX_NAMES, LEVELS, SLACK, box_of, descend, spots_of
from sojourn.operators.components import components
from sojourn.operators.ordered import CHUNK, Keys, attach_by_key, with_id_chunk
from sojourn.operators.selection import SUBJECT
from sojourn.operators.staging import staged



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _row_height_deg(side_m: float) -> float:
    return math.degrees(side_m / EARTH_RADIUS_M)


def _col_width_deg(row, side_m: float) -> Column:
    """Width in degrees of the cells of one latitude row: at most ``side_m`` wide anywhere in the row."""
    height = _row_height_deg(side_m)
    row = _col(row)
    nearest = F.when(row >= 0, row * height).otherwise(-(row + 1) * height)
    return F.lit(height) / F.greatest(F.cos(F.radians(F.least(nearest, F.lit(90.0)))), F.lit(1e-9))


def cell_of(lat, lng, side_m: float) -> tuple[Column, Column]:
    row = F.floor(_col(lat) / _row_height_deg(side_m)).cast("bigint")
    return row, F.floor(_col(lng) / _col_width_deg(row, side_m)).cast("bigint")


def cells_around(lat_lo, lat_hi, lng_lo, lng_hi, reach_m: float, side_m: float) -> Column:
    """All cells that may hold a point within ``reach_m`` of a box, as ``array<struct(row, col)>``."""
    lat_lo, lat_hi, lng_lo, lng_hi = map(_col, (lat_lo, lat_hi, lng_lo, lng_hi))
    height = _row_height_deg(side_m)
    pad_deg = math.degrees(reach_m / EARTH_RADIUS_M) * (1 + SLACK)
    farthest = F.greatest(F.abs(lat_lo), F.abs(lat_hi))
    ratio = F.lit(math.sin(reach_m / EARTH_RADIUS_M)) / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12))
    pad_lng = F.when(ratio >= 1, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + SLACK))
    rows = F.sequence(F.floor((lat_lo - pad_deg) / height).cast("bigint"),
                      F.floor((lat_hi + pad_deg) / height).cast("bigint"))
    left = F.greatest(lng_lo - pad_lng, F.lit(-180.0))
    right = F.least(lng_hi + pad_lng, F.lit(180.0))

    def columns_of(row: Column) -> Column:
        width = _col_width_deg(row, side_m)
        span = F.sequence(F.floor(left / width).cast("bigint"), F.floor(right / width).cast("bigint"))
        return F.transform(span, lambda c: F.struct(row.alias("row"), c.alias("col")))

    return F.flatten(F.transform(rows, columns_of))


def _cell_pairs(boxes: DataFrame, k: list[str], eps_m: float, side_m: float) -> DataFrame:
    """``(keys, a_row, a_col, b_row, b_col)``: each cell with every other cell, and itself, that may hold a point within eps."""
    near = boxes.select(*k, F.col("row").alias("a_row"), F.col("col").alias("a_col"),
                        F.explode(cells_around("lat_lo", "lat_hi", "lng_lo", "lng_hi", eps_m, side_m)).alias("c"))
    near = near.select(*k, "a_row", "a_col", F.col("c.row").alias("b_row"), F.col("c.col").alias("b_col"))
    return near.join(boxes.select(*k, F.col("row").alias("b_row"), F.col("col").alias("b_col")), [*k, "b_row", "b_col"])


def _spots(placed: DataFrame, k: list[str], side_m: float) -> DataFrame:
    return spots_of(placed, k, _row_height_deg(side_m), lambda row: _col_width_deg(row, side_m))


def _core_edges(cells: DataFrame, spots: DataFrame, k: list[str], eps_m: float, side_m: float) -> DataFrame:
    """Edges ``(u, v)`` between the nodes of core cells that hold at least one pair of core spots within eps."""
    pairs = _cell_pairs(cells, k, eps_m, side_m).filter("a_row < b_row OR (a_row = b_row AND a_col < b_col)")
    for s, end in (("a", "u"), ("b", "v")):
        pairs = pairs.join(cells.select(*k, F.col("row").alias(f"{s}_row"), F.col("col").alias(f"{s}_col"), F.col("node").alias(end)),
                           [*k, f"{s}_row", f"{s}_col"])
    sure, near = descend(pairs, spots, k, eps_m, settle="u v")
    return sure.select(*k, "u", "v").unionByName(near.select(*k, "u", "v")).distinct()


_SPOT = ["row", "col", "lat", "lng"]


def _by_spots(found: tuple[DataFrame, DataFrame], spots: DataFrame, k: list[str], value: Column, merge, name: str) -> DataFrame:
    """``(keys, row, col, lat, lng, name)``: a value of the pairs found by a descent, merged for each spot of their first cells."""
    sure, near = found
    at = ["row", "col", "level", "box_row", "box_col"]
    boxes = sure.groupBy(*k, *[F.col(f"a_{c}" if c != "level" else c).alias(c) for c in at]).agg(merge(value).alias(name))
    levels = F.array(*[F.struct(F.lit(n).alias("level"), box_of("fine_row", n).alias("box_row"), box_of("fine_col", n).alias("box_col"))
                       for n in range(LEVELS + 1)])
    whole = spots.select(*k, *_SPOT, F.explode(levels).alias("b")).select(*k, *_SPOT, "b.*").join(boxes, [*k, *at]).select(*k, *_SPOT, name)
    single = near.select(*k, *[F.col(f"a_{c}").alias(c) for c in _SPOT], value.alias(name))
    return whole.unionByName(single).groupBy(*k, *_SPOT).agg(merge(name).alias(name))


def _weight(column: str | None) -> Column:
    """The weight of a point; negative or missing ones are an error."""
    if column is None:
        return F.lit(1.0)
    w = F.col(column).cast("double")
    return F.when(w >= 0, w).otherwise(F.raise_error(F.lit("weights must be 0 or more")).cast("double"))


def eps_neighbour_weights(items: DataFrame, eps_m: float = CLUSTER_EPS_M, keys: Keys = SUBJECT, id_col: str = "sid",
                          weight_col: str | None = None) -> DataFrame:
    """``(keys, id, weight)``: how much lies within ``eps_m`` of each item, itself included.

    Boxes that lie within reach of each other as a whole are counted at once, at whatever level of their cells; only spots
    at the rim are compared one by one.
    """
    k = list(keys)
    side_m = eps_m / math.sqrt(2) * (1 - 1e-6)
    row, col = cell_of("lat", "lng", side_m)
    placed = staged(with_id_chunk(items.select(*k, F.col(id_col).cast("bigint").alias("id"), "lat", "lng", _weight(weight_col).alias("w"),
                                               row.alias("row"), col.alias("col")), "id"))
    spots = staged(_spots(placed, k, side_m))
    cells = spots.groupBy(*k, "row", "col").agg(*[f(c).alias(n) for f, c, n in BOX])
    found = descend(_cell_pairs(cells, k, eps_m, side_m), spots, k, eps_m)
    per_spot = _by_spots(found, spots, k, F.col("b_w"), F.sum, "weight")
    # Many items of one spot are joined by blocks of ids.
    return attach_by_key(placed, per_spot, [*k, *_SPOT]).select(*k, F.col("id").alias(id_col), "weight")


def dbscan(items: DataFrame, eps_m: float = CLUSTER_EPS_M, min_pts: float = CLUSTER_MIN_PTS, keys: Keys = SUBJECT,
           id_col: str = "sid", weight_col: str | None = None, items_staged: bool = False) -> DataFrame:
    """``(keys, id, cluster_id)``: core points and what they reach; noise is -1.

    Clusters are numbered per key by their smallest core id, and a border point joins the lowest-numbered cluster
    that reaches it, so the result does not depend on row order or partitioning. ``items`` are read several times and
    therefore staged, unless ``items_staged`` says that they already are.
    """
    k = list(keys)
    side_m = eps_m / math.sqrt(2) * (1 - 1e-6)
    row, col = cell_of("lat", "lng", side_m)
    placed = with_id_chunk(items.select(*k, F.col(id_col).cast("bigint").alias("id"), "lat", "lng",
                                        _weight(weight_col).alias("w"), row.alias("row"), col.alias("col")), "id")
    if not items_staged:
        placed = staged(placed)
    spots = staged(_spots(placed, k, side_m))
    cell = [*k, "row", "col"]
    box = [f(c).alias(n) for f, c, n in BOX]
    cells = staged(spots.groupBy(*cell).agg(F.sum("w").alias("w"), F.min("low").alias("node"), *box))
    full, thin = cells.filter(F.col("w") >= min_pts), cells.filter(F.col("w") < min_pts)

    # Core spots of thin cells: enough weight around them.
    thin_pairs = _cell_pairs(cells, k, eps_m, side_m).join(thin.select(*k, F.col("row").alias("a_row"), F.col("col").alias("a_col")), [*k, "a_row", "a_col"], "left_semi")
    thin_spots = spots.join(thin.select(*cell), cell, "left_semi")
    around = _by_spots(descend(thin_pairs, spots, k, eps_m), thin_spots, k, F.col("b_w"), F.sum, "weight")
    around = staged(thin_spots.join(around, [*k, *_SPOT]).withColumn("core", F.col("weight") >= min_pts).drop("weight"))
    thin_core, rest = around.filter("core").drop("core"), around.filter("NOT core").drop("core")

    # The core spots of a cell are one node; cells are joined where two of their core spots are within eps.
    core_cells = staged(full.select(*cell, "node", *BOX_NAMES).unionByName(
        thin_core.groupBy(*cell).agg(F.min("low").alias("node"), *box)))
    core_spots = staged(spots.join(full.select(*cell), cell, "left_semi").unionByName(thin_core))
    merged = components(_core_edges(core_cells, core_spots, k, eps_m, side_m), keys)
    rooted = core_cells.join(merged, [*k, "node"], "left").select(*cell, *BOX_NAMES, F.coalesce("root", "node").alias("root"))
    numbered = rooted.select(*k, "root").distinct().withColumn(
        "cluster_id", (F.row_number().over(Window.partitionBy(*k).orderBy("root")) - 1).cast("int"))
    labelled = staged(rooted.join(numbered, [*k, "root"]).select(*cell, *BOX_NAMES, "cluster_id"))

    # Other spots join the lowest-numbered cluster of which a core spot is within eps.
    rest_cells = rest.groupBy(*cell).agg(*box)
    near = rest_cells.select(*k, F.col("row").alias("a_row"), F.col("col").alias("a_col"),
                             F.explode(cells_around("lat_lo", "lat_hi", "lng_lo", "lng_hi", eps_m, side_m)).alias("c"))
    near = near.select(*k, "a_row", "a_col", F.col("c.row").alias("b_row"), F.col("c.col").alias("b_col")).join(
        labelled.select(*k, F.col("row").alias("b_row"), F.col("col").alias("b_col"), "cluster_id"), [*k, "b_row", "b_col"])
    touching = _by_spots(descend(near, rest, k, eps_m, others=core_spots), rest, k, F.col("cluster_id"), F.min, "cluster_id")
    core = core_spots.select(*k, *_SPOT).join(labelled.select(*cell, "cluster_id"), cell)
    per_spot = core.unionByName(touching.select(*k, *_SPOT, "cluster_id"))
    # Many items of one spot are joined by blocks of ids.
    found = attach_by_key(placed, per_spot, [*k, *_SPOT], how="left")
    return found.select(*k, F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
