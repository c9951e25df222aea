"""Map layers: heat scale and cells, routes, route frequencies, opening bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import (
    BOUNDS_CELL_DEG,
    BOUNDS_HIGH,
    BOUNDS_LOW,
    BOUNDS_MIN_SPAN_DEG,
    HEAT_CELLS_ACROSS,
    HEAT_GAMMA,
    HEAT_MAX_CELL_M,
    HEAT_QUIET_SHARE,
    METERS_PER_DEGREE,
    MIN_SPAN_DEG,
    PLAUSIBLE_MAX_KMH,
    ROUTE_CELL_M,
    ROUTE_GAP_SEC,
    ROUTE_KEEP_WHOLE_BELOW,
    ROUTE_LEVELS,
    ROUTE_MIN_POINTS,
)
from sojourn.functions import geo
from sojourn.operators.ordered import CHUNK, Keys, attach_by_key, attach_totals, scan
from sojourn.operators.selection import SUBJECT, movement_points


# --- heat -------------------------------------------------------------------------------

def _with_cell_size(points: DataFrame, keys: Keys) -> DataFrame:
    boxed = attach_totals(points, keys, lat0=(F.min("lat"), F.min), lat1=(F.max("lat"), F.max),
                          lng0=(F.min("lng"), F.min), lng1=(F.max("lng"), F.max))
    span = F.greatest(F.col("lat1") - F.col("lat0"), F.col("lng1") - F.col("lng0"), F.lit(MIN_SPAN_DEG))
    size = F.least(span / HEAT_CELLS_ACROSS, F.lit(HEAT_MAX_CELL_M / METERS_PER_DEGREE))
    return boxed.withColumn("cell_size", size).drop("lat0", "lat1", "lng0", "lng1")


def heat_scale(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """The fixed frame of a key: cell size, and the log counts where colour starts and ends."""
    moving = movement_points(points, keys, chunk_sec).select(*keys, CHUNK, "lat", "lng")
    sized = _with_cell_size(moving, keys)
    cells = sized.groupBy(*keys, "cell_size", geo.cell("lat", "cell_size").alias("cy"),
                          geo.cell("lng", "cell_size").alias("cx")).agg(F.count(F.lit(1)).alias("c"))
    # The quiet count is picked by rank. Equal counts are merged first, so the window sees distinct counts only
    # (k different counts need at least k*k/2 points).
    levels = cells.groupBy(*keys, "cell_size", "c").agg(F.count(F.lit(1)).alias("m"))
    rising = Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.select("*", F.sum("m").over(rising).alias("upto"),
                           F.sum("m").over(Window.partitionBy(*keys)).alias("n"))
    target = F.floor((F.col("n") - 1) * F.lit(HEAT_QUIET_SHARE))
    picked = levels.groupBy(*keys, "cell_size").agg(
        F.min(F.when(F.col("upto") > target, F.col("c"))).alias("quiet"), F.max("c").alias("peak"))
    floor_log = F.least(F.log1p("quiet"), F.log1p("peak") * 0.5)
    return (picked.withColumn("floor_log", floor_log)
            .withColumn("peak_log", F.greatest(F.log1p("peak"), F.col("floor_log") + 1e-6))
            .select(*keys, "cell_size", "floor_log", "peak_log"))


def heat_cells(points: DataFrame, scale: DataFrame, keys: Keys = SUBJECT, scale_keys: Keys = SUBJECT,
               chunk_sec: int | None = None) -> DataFrame:
    """Mean position and intensity of each cell of a slice, measured against the whole history's scale."""
    moving = movement_points(points, keys, chunk_sec).select(*keys, CHUNK, "ord", "lat", "lng")
    framed = attach_by_key(moving, scale, scale_keys)
    cells = framed.groupBy(*keys, geo.cell("lat", "cell_size").alias("cell_y"),
                           geo.cell("lng", "cell_size").alias("cell_x")).agg(
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("cnt"),
        F.min("ord").alias("first_ord"), F.max("floor_log").alias("lo"), F.max("peak_log").alias("hi"))
    linear = (F.log1p("cnt") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return (cells.withColumn("_linear", linear).filter("_linear > 0")
            .withColumn("intensity", F.pow(F.least("_linear", F.lit(1.0)), F.lit(HEAT_GAMMA)))
            .drop("_linear", "lo", "hi"))


def heat_top_cells(cells: DataFrame, n: int, keys: Keys = SUBJECT, spread: int = 64) -> DataFrame:
    """The n most intense cells of each key (first seen wins ties).

    Each key's cells are ranked in ``spread`` parts first, so the final ranking sees at most ``spread * n`` rows of a key.
    """
    best = (F.desc("intensity"), F.asc("first_ord"))
    part = F.pmod(F.xxhash64("cell_y", "cell_x"), F.lit(spread))
    heads = (cells.withColumn("_part", part)
             .withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*best)))
             .filter(F.col("_r") <= n).drop("_part", "_r"))
    return (heads.withColumn("heat_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))
            .filter(F.col("heat_rank") <= n))


# --- routes -----------------------------------------------------------------------------

_TRACK = ("ts_sec", "lat", "lng")


_DT = "(ts_sec - prev_ts_sec)"
_KM = geo.haversine_sql("prev_lat", "prev_lng", "lat", "lng") + " / 1000"
_KEPT = f"prev_ts_sec IS NULL OR {_DT} > 0"
_BREAKS = f"{_DT} > 0 AND ({_DT} > {ROUTE_GAP_SEC} OR {_KM} / ({_DT} / 3600) > {PLAUSIBLE_MAX_KMH}D)"


def routes(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None,
           min_points: int = ROUTE_MIN_POINTS) -> DataFrame:
    """Vertices of each unbroken segment: ``segment_id``, ``idx`` in it, ``segment_len``, ``pos`` in the key's track."""
    moving = movement_points(points, keys, chunk_sec).select(*keys, CHUNK, "ord", *_TRACK)
    walked = scan(moving, keys, _TRACK, {"segment_id": _BREAKS, "kept": _KEPT})
    vertices = walked.filter(_KEPT)
    vertices = vertices.withColumn("pos", F.col("kept") - 1).drop("kept", *[f"prev_{c}" for c in _TRACK])
    # A segment may be as long as the history, so its length is totalled over the chunks it touches.
    sized = attach_totals(vertices, [*keys, "segment_id"], segment_len=(F.count(F.lit(1)), F.sum),
                          _start=(F.min("pos"), F.min))
    return (sized.filter(F.col("segment_len") >= min_points)
            .withColumn("idx", F.col("pos") - F.col("_start")).drop("_start"))


def route_thin(vertices: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th vertex of longer segments and each last one; short segments stay whole. For drawing only."""
    return vertices.filter((F.col("segment_len") < ROUTE_KEEP_WHOLE_BELOW) | (F.col("idx") % stride == 0)
                           | (F.col("idx") == F.col("segment_len") - 1))


def route_density(vertices: DataFrame, keys: Keys = SUBJECT, cell_m: float = ROUTE_CELL_M) -> DataFrame:
    """Passes per stretch between two grid cells, both directions together; geometry of the first pass."""
    size = cell_m / METERS_PER_DEGREE
    carried = ("segment_id", "lat", "lng")
    steps = scan(vertices.select(*keys, CHUNK, "pos", *carried), keys, carried, {}, order=("pos",))
    steps = steps.filter(F.col("prev_segment_id") == F.col("segment_id"))
    a_y, a_x = geo.cell("prev_lat", size), geo.cell("prev_lng", size)
    b_y, b_x = geo.cell("lat", size), geo.cell("lng", size)
    forward = (a_y < b_y) | ((a_y == b_y) & (a_x <= b_x))
    steps = steps.filter((a_y != b_y) | (a_x != b_x)).select(
        *keys, "pos", "prev_lat", "prev_lng", "lat", "lng",
        F.when(forward, a_y).otherwise(b_y).alias("y1"), F.when(forward, a_x).otherwise(b_x).alias("x1"),
        F.when(forward, b_y).otherwise(a_y).alias("y2"), F.when(forward, b_x).otherwise(a_x).alias("x2"))
    return steps.groupBy(*keys, "y1", "x1", "y2", "x2").agg(
        F.min_by("prev_lat", "pos").alias("a_lat"), F.min_by("prev_lng", "pos").alias("a_lng"),
        F.min_by("lat", "pos").alias("b_lat"), F.min_by("lng", "pos").alias("b_lng"),
        F.count(F.lit(1)).alias("passes"), F.min("pos").alias("first_pos"))


def edges_sorted(edges: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return edges.orderBy(*keys, "passes", "first_pos")


def route_levels(edges: DataFrame, keys: Keys = SUBJECT, levels: int = ROUTE_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Frequency levels on a log scale: the edges with their level, and one summary row per level."""
    # Edges are grouped by pass count first; the key-wide maximum is taken over distinct counts.
    by_count = edges.groupBy(*keys, "passes").agg(F.count(F.lit(1)).alias("m"))
    top = F.max("passes").over(Window.partitionBy(*keys))
    share = F.when(top > 0, F.log1p("passes") / F.log1p(top)).otherwise(F.lit(1.0))
    level = F.least(F.lit(levels - 1), F.floor(share * levels)).cast("int")
    graded = by_count.withColumn("level", level)
    t = F.lit(1.0) if levels == 1 else F.col("level") / F.lit(float(levels - 1))
    summary = graded.groupBy(*keys, "level").agg(
        F.sum("m").alias("edge_count"), F.min("passes").alias("min_passes"), F.max("passes").alias("max_passes"),
    ).withColumn("t", t)
    return edges.join(graded.select(*keys, "passes", "level"), [*keys, "passes"]), summary


# --- bounds -----------------------------------------------------------------------------

def _ranked(points: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, axis, low, high)``: the exact values at the two percentile ranks of each axis, over all rows.

    Rows are counted by value; values lie in cells of a thousandth of a degree, and only the cells that hold a wanted rank
    are looked into, so no window sees a key's rows, only its cells or the distinct values of one cell.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("lat", "lng")])).alias("x")
    values = (points.select(*keys, axes).select(*keys, "x.axis", "x.v").filter("v IS NOT NULL")
              .withColumn("cell", F.floor(F.col("v") / F.lit(BOUNDS_CELL_DEG)))
              .groupBy(*keys, "axis", "cell", "v").agg(F.count(F.lit(1)).alias("c")))
    whole = Window.partitionBy(*keys, "axis")
    cells = values.groupBy(*keys, "axis", "cell").agg(F.sum("c").alias("m"))
    cells = cells.select("*", (F.sum("m").over(whole.orderBy("cell")) - F.col("m")).alias("base"), F.sum("m").over(whole).alias("n"))
    ranks = F.explode(F.array(F.struct(F.lit("low").alias("end"), F.floor((F.col("n") - 1) * F.lit(BOUNDS_LOW)).alias("rank")),
                              F.struct(F.lit("high").alias("end"), F.ceil((F.col("n") - 1) * F.lit(BOUNDS_HIGH)).alias("rank")))).alias("w")
    wanted = cells.select(*keys, "axis", "cell", "base", "m", ranks).filter("w.rank >= base AND w.rank < base + m")
    inside = values.join(wanted.select(*keys, "axis", "cell", "base", "w.end", "w.rank"), [*keys, "axis", "cell"])
    upto = Window.partitionBy(*keys, "axis", "end").orderBy("v")
    reached = inside.withColumn("upto", F.col("base") + F.sum("c").over(upto)).filter("upto > rank")
    picked = reached.groupBy(*keys, "axis", "end").agg(F.min("v").alias("v"))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when((F.col("axis") == a) & (F.col("end") == e), F.col("v"))).alias(n)
        for a, e, n in (("lat", "low", "min_lat"), ("lng", "low", "min_lng"), ("lat", "high", "max_lat"), ("lng", "high", "max_lng"))])


def robust_bounds(points: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The 2nd to 98th percentile box (exact ranks of all points), or the padded true extent when that is thin."""
    core = _ranked(points, keys)
    extent = points.groupBy(*keys).agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
                                       F.min("lng").alias("lng0"), F.max("lng").alias("lng1"))
    thin = ((F.col("max_lat") - F.col("min_lat") < BOUNDS_MIN_SPAN_DEG)
            | (F.col("max_lng") - F.col("min_lng") < BOUNDS_MIN_SPAN_DEG))

    def padded(lo, hi, sign):
        edge = F.col(lo) if sign < 0 else F.col(hi)
        return F.when(F.col(hi) - F.col(lo) < BOUNDS_MIN_SPAN_DEG, edge + sign * BOUNDS_MIN_SPAN_DEG / 2).otherwise(edge)

    return core.join(extent, list(keys)).select(
        *keys,
        F.when(thin, padded("lat0", "lat1", -1)).otherwise(F.col("min_lat")).alias("min_lat"),
        F.when(thin, padded("lng0", "lng1", -1)).otherwise(F.col("min_lng")).alias("min_lng"),
        F.when(thin, padded("lat0", "lat1", 1)).otherwise(F.col("max_lat")).alias("max_lat"),
        F.when(thin, padded("lng0", "lng1", 1)).otherwise(F.col("max_lng")).alias("max_lng"))
