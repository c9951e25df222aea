"""Legs, modes, days, journeys, selection."""

from pyspark.sql import functions as F

from sojourn.functions import calendar
from sojourn.operators import movement, selection
from workload.fixtures import Inputs
from workload.registry import query


@query("legs", """SELECT subject_id, ord, ts_sec, dt_sec, round(km, 6) AS km, round(kmh, 6) AS kmh, counted FROM leg""", "leg")
def _(t: Inputs):
    return movement.legs(t.points).select("subject_id", "ord", "ts_sec", "dt_sec", F.round("km", 6).alias("km"),
                                          F.round("kmh", 6).alias("kmh"), "counted")


@query("speed_mode", "SELECT subject_id, mode, count(*) AS legs, round(sum(km), 6) AS km FROM leg WHERE counted GROUP BY ALL", "leg")
def _(t: Inputs):
    return movement.legs(t.points).filter("counted").groupBy("subject_id", "mode").agg(
        F.count(F.lit(1)).alias("legs"), F.round(F.sum("km"), 6).alias("km"))


@query("gap_flags", """SELECT subject_id, ord, coalesce(dt_sec > 1500, false) AS time_gap, coalesce(kmh < 1.5, false) AS stationary,
    coalesce(kmh > 200, false) AS jump, CAST(journey_no AS BIGINT) AS journey_no FROM jrow""", "jrow")
def _(t: Inputs):
    return movement.gap_flags(t.points).select("subject_id", "ord", "time_gap", "stationary", "jump", "journey_no")


@query("km_by_mode", "SELECT subject_id, mode, round(km, 6) AS km, labelled FROM mode_km", "mode_km")
def _(t: Inputs):
    return movement.km_by_mode(t.points, t.activities).select("subject_id", "mode", F.round("km", 6).alias("km"), "labelled")


@query("activities_or_heuristic", "SELECT subject_id, mode, round(km, 6) AS km, labelled FROM mode_km WHERE km > 0", "mode_km")
def _(t: Inputs):
    return movement.activities_or_heuristic(t.points, t.activities).select(
        "subject_id", "mode", F.round("km", 6).alias("km"), "labelled")


@query("total_km", "SELECT subject_id, round(sum(km), 6) AS total_km FROM mode_km GROUP BY 1", "mode_km")
def _(t: Inputs):
    return movement.total_km(movement.km_by_mode(t.points, t.activities)).select(
        "subject_id", F.round("total_km", 6).alias("total_km"))


@query("km_by_day", "SELECT subject_id, day, round(km, 6) AS km FROM day_km", "day_km")
def _(t: Inputs):
    return movement.km_by_day(movement.legs(t.points)).select("subject_id", "day", F.round("km", 6).alias("km"))


@query("farthest_day", "SELECT subject_id, day, round(km, 6) AS km FROM far_day", "far_day")
def _(t: Inputs):
    return movement.farthest_day(movement.km_by_day(movement.legs(t.points))).select(
        "subject_id", "day", F.round("km", 6).alias("km"))


@query("journeys", "SELECT subject_id, start_sec, end_sec, duration_sec, round(km, 6) AS km FROM journeys", "journeys")
def _(t: Inputs):
    return movement.journeys(t.points).select("subject_id", "start_sec", "end_sec", "duration_sec", F.round("km", 6).alias("km"))


@query("longest_journey", "SELECT subject_id, start_sec, end_sec, duration_sec, from_trip, round(km, 6) AS km FROM longest", "longest")
def _(t: Inputs):
    return movement.longest_journey(movement.journeys(t.points), t.trips).select(
        "subject_id", "start_sec", "end_sec", "duration_sec", "from_trip", F.round("km", 6).alias("km"))


@query("select_source", "SELECT subject_id, ord, round(lat, 6) AS lat, round(lng, 6) AS lng, ts_sec FROM points WHERE source = 'visit'", "points")
def _(t: Inputs):
    return selection.select_source(t.points, "visit").select(
        "subject_id", "ord", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "ts_sec")


_NO_MOVES = "CASE WHEN subject_id = 'u9' THEN 'visit' ELSE source END"


@query("movement_points", f"""SELECT p.subject_id, p.ord, p.ts_sec, p.src AS source
    FROM (SELECT *, {_NO_MOVES} AS src, bool_or({_NO_MOVES} = 'movement') OVER (PARTITION BY subject_id) AS m FROM points) p
    WHERE p.src = 'movement' OR NOT p.m""", "points")
def _(t: Inputs):
    return selection.movement_points(t.points.withColumn("source", F.expr(_NO_MOVES))).select(
        "subject_id", "ord", "ts_sec", "source")


_KYIV = "Europe/Kyiv"


@query("range_filter", """SELECT 'point' AS kind, subject_id, ts_sec AS at, count(*) AS cnt FROM points WHERE ts_sec >= 1704060000 AND ts_sec < 1706738400 GROUP BY ALL
    UNION ALL SELECT 'activity', subject_id, start_sec, count(*) FROM activities WHERE start_sec >= 1704060000 AND start_sec < 1706738400 GROUP BY ALL
    UNION ALL SELECT 'trip', subject_id, start_sec, count(*) FROM trips WHERE start_sec >= 1704060000 AND start_sec < 1706738400 GROUP BY ALL""",
       "points", "activities", "trips")
def _(t: Inputs):
    parts = [("point", t.points, "ts_sec"), ("activity", t.activities, "start_sec"), ("trip", t.trips, "start_sec")]
    out = None
    for kind, df, column in parts:
        part = (selection.range_filter(df, "y2024m01", _KYIV, column)
                .groupBy(F.lit(kind).alias("kind"), "subject_id", F.col(column).alias("at"))
                .agg(F.count(F.lit(1)).alias("cnt")))
        out = part if out is None else out.unionByName(part)
    return out


@query("range_bounds", """SELECT DISTINCT k.key AS period_key,
      CAST(epoch(CASE WHEN k.key LIKE '%m%' THEN date_trunc('month', d) ELSE date_trunc('year', d) END) AS BIGINT) AS start_sec,
      CAST(epoch(CASE WHEN k.key LIKE '%m%' THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE date_trunc('year', d) + INTERVAL 1 YEAR END) AS BIGINT) AS end_sec
    FROM (SELECT make_timestamp(ts_sec * 1000000) AS d FROM points) p,
      LATERAL (SELECT strftime(d, 'y%Y') AS key UNION ALL SELECT strftime(d, 'y%Ym%m')) k""", "points")
def _(t: Inputs):
    start, end = calendar.period_bound_columns("period_key")
    periods = selection.period_explode(t.points).select("period_key").distinct().filter("period_key <> 'all'")
    return periods.select("period_key", start.alias("start_sec"), end.alias("end_sec"))


@query("period_explode", """SELECT subject_id, k.key AS period_key, count(*) AS cnt, min(ts_sec) AS first_sec, max(ts_sec) AS last_sec
    FROM points p, LATERAL (SELECT 'all' AS key UNION ALL SELECT strftime(make_timestamp(p.ts_sec * 1000000), 'y%Y')
      UNION ALL SELECT strftime(make_timestamp(p.ts_sec * 1000000), 'y%Ym%m')) k GROUP BY ALL""", "points")
def _(t: Inputs):
    return selection.period_explode(t.points).groupBy("subject_id", "period_key").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("ts_sec").alias("first_sec"), F.max("ts_sec").alias("last_sec"))


@query("sort_by_time", """SELECT subject_id, ord, ts_sec FROM points ORDER BY subject_id, ts_sec, ord""", "points")
def _(t: Inputs):
    return selection.sort_by_time(t.points.select("subject_id", "ord", "ts_sec"))
