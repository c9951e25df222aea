"""Footprint, coverage, hours, weekdays, periods, span."""

from pyspark.sql import functions as F

from sojourn.operators import patterns
from sojourn.operators.places import share_of_top
from workload.fixtures import Inputs
from workload.registry import cte, hav, query

_MONTH = "strftime(make_timestamp(ts_sec * 1000000), '%Y-%m')"
cte("monthly", f"""SELECT subject_id, ts_sec, lat, lng, {_MONTH} AS month, avg(lat) OVER m AS c_lat, avg(lng) OVER m AS c_lng,
    avg(lat) OVER s AS e_lat, avg(lng) OVER s AS e_lng FROM points
    WINDOW m AS (PARTITION BY subject_id, {_MONTH}), s AS (PARTITION BY subject_id)""", "points")


@query("footprint_month", f"""SELECT subject_id, month, round(max(c_lat), 6) AS centroid_lat, round(max(c_lng), 6) AS centroid_lng,
      round(sqrt(avg(pow({hav('lat', 'lng', 'c_lat', 'c_lng')}, 2))) / 1000, 6) AS radius_of_gyration_km,
      round(max({hav('c_lat', 'c_lng', 'e_lat', 'e_lng')}) / 1000, 6) AS shift_from_overall_km, count(*) AS point_count
    FROM monthly GROUP BY subject_id, month""", "monthly")
def _(t: Inputs):
    return patterns.footprint_month(t.points).select(
        "subject_id", "month", *[F.round(c, 6).alias(c) for c in ("centroid_lat", "centroid_lng", "radius_of_gyration_km",
                                                                  "shift_from_overall_km")], "point_count")


cte("grid", """SELECT *, CAST(greatest(1, ceil(lng_span / size)) AS INT) AS grid_cols, CAST(greatest(1, ceil(lat_span / size)) AS INT) AS grid_rows
    FROM (SELECT *, greatest(lat_span, lng_span) / 18 AS size FROM (
      SELECT subject_id, min(lat) AS lat0, min(lng) AS lng0, greatest(max(lat) - min(lat), 1E-6) AS lat_span,
             greatest(max(lng) - min(lng), 1E-6) AS lng_span FROM points GROUP BY 1))""", "points")
cte("seen", """SELECT DISTINCT p.subject_id, g.grid_cols, g.grid_rows,
      CAST(least(floor((p.lat - g.lat0) / g.size), g.grid_rows - 1) AS INT) AS row,
      CAST(least(floor((p.lng - g.lng0) / g.size), g.grid_cols - 1) AS INT) AS col
    FROM points p JOIN grid g ON g.subject_id = p.subject_id""", "points", "grid")
cte("cover", """SELECT subject_id, count(*) AS visited_cells, max(grid_cols * grid_rows) AS total_cells,
      count(*) / max(grid_cols * grid_rows) AS coverage_ratio, max(grid_cols) AS grid_cols, max(grid_rows) AS grid_rows
    FROM seen GROUP BY 1""", "seen")


@query("coverage", "SELECT * REPLACE (round(coverage_ratio, 6) AS coverage_ratio) FROM cover", "cover")
def _(t: Inputs):
    return patterns.coverage(t.points).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("coverage_grid", """SELECT g.subject_id, r.row, c.col, s.row IS NOT NULL AS visited FROM grid g,
      LATERAL (SELECT unnest(range(g.grid_rows)) AS row) r, LATERAL (SELECT unnest(range(g.grid_cols)) AS col) c
    LEFT JOIN seen s ON s.subject_id = g.subject_id AND s.row = r.row AND s.col = c.col""", "grid", "seen")
def _(t: Inputs):
    return patterns.coverage_grid(t.points)


cte("hours", """SELECT s.subject_id, h.hour, count(p.ts_sec) AS cnt FROM (SELECT DISTINCT subject_id FROM points) s
    CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS hour) h
    LEFT JOIN points p ON p.subject_id = s.subject_id AND hour(make_timestamp(p.ts_sec * 1000000)) = h.hour GROUP BY ALL""", "points")
cte("weekdays", """SELECT s.subject_id, d.weekday, count(p.ts_sec) AS cnt FROM (SELECT DISTINCT subject_id FROM points) s
    CROSS JOIN (SELECT CAST(unnest(range(7)) AS INT) AS weekday) d
    LEFT JOIN points p ON p.subject_id = s.subject_id AND isodow(make_timestamp(p.ts_sec * 1000000)) - 1 = d.weekday GROUP BY ALL""",
    "points")


@query("time_by_hour", "SELECT subject_id, hour, cnt FROM hours", "hours")
def _(t: Inputs):
    return patterns.time_by_hour(t.points)


@query("time_by_weekday", "SELECT subject_id, weekday, cnt FROM weekdays", "weekdays")
def _(t: Inputs):
    return patterns.time_by_weekday(t.points)


cte("busy", """SELECT h.subject_id, h.hour AS busiest_hour, d.weekday AS busiest_weekday FROM
      (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY cnt DESC, hour) AS rn FROM hours) h
    JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY cnt DESC, weekday) AS rn FROM weekdays) d
      ON d.subject_id = h.subject_id AND d.rn = 1 WHERE h.rn = 1""", "hours", "weekdays")


@query("busiest", "SELECT * FROM busy", "busy")
def _(t: Inputs):
    return patterns.busiest(t.points)


@query("share_of_top", """SELECT subject_id, hour, cnt, round(cnt / greatest(max(cnt) OVER (PARTITION BY subject_id), 1), 6) AS share_of_top
    FROM hours""", "hours")
def _(t: Inputs):
    return share_of_top(patterns.time_by_hour(t.points), "cnt").withColumn("share_of_top", F.round("share_of_top", 6))


@query("available_periods", """SELECT subject_id, year, string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) AS months FROM
      (SELECT DISTINCT subject_id, CAST(year(make_timestamp(ts_sec * 1000000)) AS INT) AS year,
              month(make_timestamp(ts_sec * 1000000)) AS month FROM points) GROUP BY ALL""", "points")
def _(t: Inputs):
    return patterns.available_periods(t.points).withColumn("months", F.expr("array_join(transform(months, m -> string(m)), ',')"))


@query("span_days", "SELECT * REPLACE (round(span_days, 6) AS span_days) FROM spans", "spans")
def _(t: Inputs):
    return patterns.span_days(t.points).withColumn("span_days", F.round("span_days", 6))
