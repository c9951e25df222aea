"""Where and when: monthly footprint, coverage, hours and weekdays, available periods, span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import COVERAGE_CELLS_ACROSS, MIN_SPAN_DEG
from sojourn.functions import calendar, geo
from sojourn.operators.ordered import CHUNK, Keys, attach_totals, with_time_chunk
from sojourn.operators.selection import SUBJECT


def footprint_month(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Per UTC month: centroid, radius of gyration, shift from the all-time centroid, number of points."""
    chunked = with_time_chunk(points, keys, chunk_sec).select(*keys, CHUNK, "ts_sec", "lat", "lng")
    # A chunk lies inside one UTC day, so the month is a function of the chunk.
    sums = chunked.groupBy(*keys, CHUNK).agg(
        F.min("ts_sec").alias("t"), F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"),
        F.count(F.lit(1)).alias("m")).withColumn("month", calendar.utc_month("t"))
    monthly, ever = Window.partitionBy(*keys, "month"), Window.partitionBy(*keys)

    def mean(column, over):
        return F.sum(column).over(over) / F.sum("m").over(over)

    centres = sums.select(
        *keys, CHUNK, "month", mean("lat_sum", monthly).alias("c_lat"), mean("lng_sum", monthly).alias("c_lng"),
        mean("lat_sum", ever).alias("e_lat"), mean("lng_sum", ever).alias("e_lng"))
    away = geo.haversine_m("lat", "lng", "c_lat", "c_lng")
    return (chunked.join(centres, [*keys, CHUNK]).withColumn("_d", away)
            .groupBy(*keys, "month").agg(
                F.max("c_lat").alias("centroid_lat"), F.max("c_lng").alias("centroid_lng"),
                (F.sqrt(F.avg(F.col("_d") * F.col("_d"))) / 1000).alias("radius_of_gyration_km"),
                F.max("e_lat").alias("_e_lat"), F.max("e_lng").alias("_e_lng"),
                F.count(F.lit(1)).alias("point_count"))
            .withColumn("shift_from_overall_km",
                        geo.haversine_m("centroid_lat", "centroid_lng", "_e_lat", "_e_lng") / 1000)
            .drop("_e_lat", "_e_lng"))


def with_grid(boxes: DataFrame) -> DataFrame:
    """Adds the grid of a bounding box (``lat0, lat1, lng0, lng1``): ``size`` of its cells, ``grid_cols`` and ``grid_rows``."""
    boxed = boxes.withColumns({"lat_span": F.greatest(F.col("lat1") - F.col("lat0"), F.lit(MIN_SPAN_DEG)),
                               "lng_span": F.greatest(F.col("lng1") - F.col("lng0"), F.lit(MIN_SPAN_DEG))})
    boxed = boxed.withColumn("size", F.greatest("lat_span", "lng_span") / COVERAGE_CELLS_ACROSS)
    return boxed.withColumns({"grid_cols": F.greatest(F.lit(1), F.ceil(F.col("lng_span") / F.col("size"))).cast("int"),
                              "grid_rows": F.greatest(F.lit(1), F.ceil(F.col("lat_span") / F.col("size"))).cast("int")}).drop("lat_span", "lng_span")


def grid_row(lat, lat0, size, grid_rows):
    return F.least(F.floor((lat - lat0) / size), grid_rows - 1).cast("int")


def _visited_cells(points: DataFrame, keys: Keys, chunk_sec: int | None) -> DataFrame:
    """Distinct visited (row, col) per key together with the grid's size."""
    chunked = with_time_chunk(points, keys, chunk_sec).select(*keys, CHUNK, "lat", "lng")
    boxed = with_grid(attach_totals(chunked, keys, lat0=(F.min("lat"), F.min), lat1=(F.max("lat"), F.max),
                                    lng0=(F.min("lng"), F.min), lng1=(F.max("lng"), F.max)))
    row = grid_row(F.col("lat"), F.col("lat0"), F.col("size"), F.col("grid_rows"))
    col = grid_row(F.col("lng"), F.col("lng0"), F.col("size"), F.col("grid_cols"))
    return boxed.select(*keys, "grid_cols", "grid_rows", row.alias("row"), col.alias("col")).distinct()


def coverage(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Visited and total cells of a grid 18 cells across the history's bounding box."""
    return coverage_of(_visited_cells(points, keys, chunk_sec), keys)


def coverage_of(cells: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The same from the distinct visited cells."""
    total = F.max(F.col("grid_cols") * F.col("grid_rows"))
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visited_cells"), total.alias("total_cells"),
        (F.count(F.lit(1)) / total).alias("coverage_ratio"),
        F.max("grid_cols").alias("grid_cols"), F.max("grid_rows").alias("grid_rows"))


def coverage_grid(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Every cell of that grid, row by row, with its visited flag. The grid has at most some 19 x 19 cells per key."""
    seen = _visited_cells(points, keys, chunk_sec)
    whole = F.collect_set(F.col("row") * F.col("grid_cols") + F.col("col"))
    grids = seen.groupBy(*keys).agg(F.max("grid_cols").alias("grid_cols"), F.max("grid_rows").alias("grid_rows"),
                                    whole.alias("hit"))
    index = F.sequence(F.lit(0), F.col("grid_cols") * F.col("grid_rows") - 1)
    flat = grids.select(*keys, "grid_cols", "hit", F.explode(index).alias("i"))
    return flat.select(*keys, F.floor(F.col("i") / F.col("grid_cols")).cast("int").alias("row"),
                       (F.col("i") % F.col("grid_cols")).cast("int").alias("col"),
                       F.array_contains("hit", F.col("i")).alias("visited"))


def coverage_array(grid: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The grid of a key as one row-major boolean array."""
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "visited")))
    return grid.groupBy(*keys).agg(F.transform(cells, lambda c: c["visited"]).alias("visited"))


def dense_counts(counts: DataFrame, keys: Keys, name: str, size: int) -> DataFrame:
    """``(keys, name, cnt)`` with all slots 0 to ``size`` - 1 of each key."""
    found = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, "cnt"))).alias("_m"))
    slots = F.array(*[F.lit(i) for i in range(size)])
    return (found.select(*keys, "_m", F.explode(slots).alias(name))
            .select(*keys, name, F.coalesce(F.try_element_at("_m", F.col(name)), F.lit(0)).alias("cnt")))


def time_by_hour(points: DataFrame, keys: Keys = SUBJECT, tz: str = "UTC") -> DataFrame:
    """Points per local hour; all 24 hours are present."""
    counts = points.groupBy(*keys, calendar.local_hour("ts_sec", tz).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))
    return dense_counts(counts, keys, "hour", 24)


def time_by_weekday(points: DataFrame, keys: Keys = SUBJECT, tz: str = "UTC") -> DataFrame:
    """Points per local weekday, Monday first; all seven are present."""
    counts = points.groupBy(*keys, calendar.local_weekday("ts_sec", tz).alias("weekday")).agg(F.count(F.lit(1)).alias("cnt"))
    return dense_counts(counts, keys, "weekday", 7)


def busiest(points: DataFrame, keys: Keys = SUBJECT, tz: str = "UTC") -> DataFrame:
    """Busiest hour and weekday; the lowest index wins ties. One count per (weekday, hour) serves both."""
    slots = points.groupBy(*keys, calendar.local_weekday("ts_sec", tz).alias("weekday"),
                           calendar.local_hour("ts_sec", tz).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))
    return busiest_of(slots, keys)


def busiest_of(slots: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The same from counts (``cnt``) by weekday and hour."""

    def top(slot):
        per_slot = slots.groupBy(*keys, slot).agg(F.sum("cnt").alias("cnt"))
        return per_slot.groupBy(*keys).agg(F.max_by(slot, F.struct(F.col("cnt"), -F.col(slot))).alias(f"busiest_{slot}"))

    return top("hour").join(top("weekday"), list(keys))


def available_periods(points: DataFrame, keys: Keys = SUBJECT, tz: str = "UTC") -> DataFrame:
    """Years with data and the sorted months of each, in local time."""
    local = calendar.local_time("ts_sec", tz)
    return (points.select(*keys, F.year(local).alias("year"), F.month(local).alias("month")).distinct()
            .groupBy(*keys, "year").agg(F.sort_array(F.collect_set("month")).alias("months")))


def span_days(points: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """First and last second of the history, its length in days, its number of points."""
    return points.groupBy(*keys).agg(
        F.min("ts_sec").alias("first_sec"), F.max("ts_sec").alias("last_sec"),
        ((F.max("ts_sec") - F.min("ts_sec")) / 86400).alias("span_days"), F.count(F.lit(1)).alias("point_count"))
