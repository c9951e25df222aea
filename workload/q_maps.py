"""Heat, routes, bounds."""

from pyspark.sql import functions as F

from sojourn.constants import METERS_PER_DEGREE, ROUTE_CELL_M
from sojourn.functions import geo
from sojourn.operators import maplayers
from workload.fixtures import Inputs
from workload.registry import cte, query

cte("sized", """SELECT m.*, b.cell_size, floor(m.lat / b.cell_size) AS cy, floor(m.lng / b.cell_size) AS cx FROM mv m
    JOIN (SELECT subject_id, least(greatest(max(lat) - min(lat), max(lng) - min(lng), 1E-6) / 300, 120E0 / 111320E0) AS cell_size
          FROM mv GROUP BY 1) b ON b.subject_id = m.subject_id""", "mv")
cte("cell_counts", """SELECT subject_id, cell_size, cy, cx, count(*) AS c, row_number() OVER (PARTITION BY subject_id ORDER BY count(*)) - 1 AS rn,
    count(*) OVER (PARTITION BY subject_id) AS n FROM sized GROUP BY subject_id, cell_size, cy, cx""", "sized")
cte("scale", """SELECT subject_id, cell_size, floor_log, greatest(ln(1 + peak), floor_log + 1E-6) AS peak_log FROM (
      SELECT subject_id, cell_size, max(c) AS peak, least(ln(1 + max(c) FILTER (rn = CAST(floor((n - 1) * 0.35E0) AS BIGINT))), 0.5E0 * ln(1 + max(c))) AS floor_log
      FROM cell_counts GROUP BY ALL)""", "cell_counts")
_SLICE = "ts_sec >= 1704067200 AND ts_sec < 1705276800"
for _name, _part in (("heat", _SLICE), ("heat_all", "true")):
    cte(_name, f"""SELECT * EXCLUDE (lin), pow(least(lin, 1), 0.7E0) AS intensity FROM (
      SELECT g.*, (ln(1 + g.cnt) - s.floor_log) / (s.peak_log - s.floor_log) AS lin FROM (
        SELECT subject_id, CAST(cy AS BIGINT) AS cell_y, CAST(cx AS BIGINT) AS cell_x, avg(lat) AS lat, avg(lng) AS lng, count(*) AS cnt,
               min(ord) AS first_ord FROM sized WHERE {_part} GROUP BY ALL) g
      JOIN scale s ON s.subject_id = g.subject_id) WHERE lin > 0""", "sized", "scale")


@query("heat_scale", """SELECT subject_id, round(cell_size, 9) AS cell_size, round(floor_log, 6) AS floor_log, round(peak_log, 6) AS peak_log
    FROM scale""", "scale")
def _(t: Inputs):
    return maplayers.heat_scale(t.points).select("subject_id", F.round("cell_size", 9).alias("cell_size"),
                                                 F.round("floor_log", 6).alias("floor_log"), F.round("peak_log", 6).alias("peak_log"))


def _heat(t: Inputs):
    # Half a month against the scale of the whole history.
    return maplayers.heat_cells(t.points.filter(_SLICE), maplayers.heat_scale(t.points))


_CELL = "subject_id, cell_y, cell_x, round(lat, 6) AS lat, round(lng, 6) AS lng, cnt, round(intensity, 6) AS intensity"


@query("heat_cells", f"SELECT {_CELL} FROM heat", "heat")
def _(t: Inputs):
    return _heat(t).selectExpr(*_CELL.split(", ", 3)[:3], "round(lat, 6) AS lat", "round(lng, 6) AS lng", "cnt",
                               "round(intensity, 6) AS intensity")


@query("heat_top_cells", """SELECT subject_id, heat_rank, cell_y, cell_x, cnt FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
    ORDER BY cnt DESC, first_ord) AS heat_rank FROM heat_all) WHERE heat_rank <= 10""", "heat_all")
def _(t: Inputs):
    return maplayers.heat_top_cells(maplayers.heat_cells(t.points, maplayers.heat_scale(t.points)), n=10).select("subject_id", "heat_rank", "cell_y", "cell_x", "cnt")


cte("vert0", """SELECT *, count(*) OVER (PARTITION BY subject_id, segment_id) AS segment_len,
      row_number() OVER (PARTITION BY subject_id, segment_id ORDER BY ts_sec, ord) - 1 AS idx FROM (
      SELECT *, sum(brk) OVER (PARTITION BY subject_id ORDER BY ts_sec, ord ROWS UNBOUNDED PRECEDING) AS segment_id FROM (
        SELECT *, CASE WHEN dt_sec > 0 AND (dt_sec > 1500 OR kmh > 200) THEN 1 ELSE 0 END AS brk FROM trk2))
    WHERE p_ts IS NULL OR dt_sec > 0""", "trk2")
cte("vert", "SELECT * FROM vert0 WHERE segment_len >= 3", "vert0")
cte("thin", "SELECT * FROM vert WHERE segment_len < 8 OR idx % 3 = 0 OR idx = segment_len - 1", "vert")


@query("routes", "SELECT subject_id, CAST(segment_id AS BIGINT) AS segment_id, idx, segment_len, ord FROM vert", "vert")
def _(t: Inputs):
    return maplayers.routes(t.points).select("subject_id", "segment_id", "idx", "segment_len", "ord")


@query("route_thin", "SELECT subject_id, CAST(segment_id AS BIGINT) AS segment_id, idx, ord FROM thin", "thin")
def _(t: Inputs):
    return maplayers.route_thin(maplayers.routes(t.points), stride=3).select("subject_id", "segment_id", "idx", "ord")


_SIZE = "(40E0 / 111320E0)"
cte("steps", f"""SELECT *, floor(p_lat / {_SIZE}) AS ay, floor(p_lng / {_SIZE}) AS ax, floor(lat / {_SIZE}) AS by_, floor(lng / {_SIZE}) AS bx FROM (
      SELECT subject_id, segment_id, ts_sec, ord, lat, lng, lag(lat) OVER w AS p_lat, lag(lng) OVER w AS p_lng FROM vert
      WINDOW w AS (PARTITION BY subject_id, segment_id ORDER BY idx)) WHERE p_lat IS NOT NULL""", "vert")
cte("edges", """SELECT subject_id, least((ay, ax), (by_, bx)) AS c1, greatest((ay, ax), (by_, bx)) AS c2, count(*) AS passes,
      arg_min(p_lat, (ts_sec, ord)) AS a_lat, arg_min(p_lng, (ts_sec, ord)) AS a_lng,
      arg_min(lat, (ts_sec, ord)) AS b_lat, arg_min(lng, (ts_sec, ord)) AS b_lng
    FROM steps WHERE ay <> by_ OR ax <> bx GROUP BY ALL""", "steps")
_EDGE = ("subject_id", "round(a_lat, 6) AS a_lat", "round(a_lng, 6) AS a_lng", "round(b_lat, 6) AS b_lat",
         "round(b_lng, 6) AS b_lng", "passes")


@query("route_density", f"SELECT {', '.join(_EDGE)} FROM edges", "edges")
def _(t: Inputs):
    return maplayers.route_density(maplayers.routes(t.points)).selectExpr(*_EDGE)


@query("edges_sorted", f"SELECT {', '.join(_EDGE)} FROM edges ORDER BY subject_id, passes", "edges")
def _(t: Inputs):
    return maplayers.edges_sorted(maplayers.route_density(maplayers.routes(t.points))).selectExpr(*_EDGE)


@query("route_levels", """SELECT subject_id, level, count(*) AS edge_count, min(passes) AS min_passes, max(passes) AS max_passes,
      round(level / 5E0, 6) AS t FROM (SELECT *, CAST(least(5, floor(ln(1 + passes) / ln(1 + max(passes) OVER (PARTITION BY subject_id)) * 6)) AS INT) AS level
      FROM edges) GROUP BY subject_id, level""", "edges")
def _(t: Inputs):
    _, summary = maplayers.route_levels(maplayers.route_density(maplayers.routes(t.points)))
    return summary.withColumn("t", F.round("t", 6))


@query("robust_bounds", """SELECT subject_id, round(min(lat) FILTER (rl = lo), 6) AS min_lat, round(min(lng) FILTER (rg = lo), 6) AS min_lng,
      round(min(lat) FILTER (rl = hi), 6) AS max_lat, round(min(lng) FILTER (rg = hi), 6) AS max_lng FROM (
      SELECT *, floor((m - 1) * 0.02E0) AS lo, ceil((m - 1) * 0.98E0) AS hi FROM (
        SELECT subject_id, lat, lng, count(*) OVER (PARTITION BY subject_id) AS m, row_number() OVER (PARTITION BY subject_id ORDER BY lat) - 1 AS rl,
               row_number() OVER (PARTITION BY subject_id ORDER BY lng) - 1 AS rg
        FROM points)) GROUP BY 1""", "points")
def _(t: Inputs):
    return maplayers.robust_bounds(t.points).select(
        "subject_id", *[F.round(c, 6).alias(c) for c in ("min_lat", "min_lng", "max_lat", "max_lng")])


@query("grid_cell", f"SELECT subject_id, ord, CAST(floor(lat / {_SIZE}) AS BIGINT) AS cell_y, CAST(floor(lng / {_SIZE}) AS BIGINT) AS cell_x FROM points",
       "points")
def _(t: Inputs):
    size = ROUTE_CELL_M / METERS_PER_DEGREE
    return t.points.select("subject_id", "ord", geo.cell("lat", size).alias("cell_y"), geo.cell("lng", size).alias("cell_x"))
