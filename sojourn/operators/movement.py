"""Legs between consecutive points, distances by mode and day, journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.constants import JOURNEY_GAP_SEC, MODES, PLAUSIBLE_MAX_KMH, STATIONARY_KMH
from sojourn.functions import calendar, geo
from sojourn.operators.ordered import CHUNK, Keys, scan
from sojourn.operators.selection import SUBJECT, movement_points

TRACK = ("ts_sec", "lat", "lng")
_KM = geo.haversine_sql("prev_lat", "prev_lng", "lat", "lng") + " / 1000"
_DT = "(ts_sec - prev_ts_sec)"
JOURNEY_BREAKS = f"{_DT} > 0 AND ({_DT} > {JOURNEY_GAP_SEC} OR {_KM} / ({_DT} / 3600) < {STATIONARY_KMH}D)"


def track(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Movement points in time order with their predecessor and the number of journey breaks so far."""
    moving = movement_points(points, keys, chunk_sec).select(*keys, CHUNK, "ord", *TRACK)
    return scan(moving, keys, TRACK, {"journey_no": JOURNEY_BREAKS})


def measured(tracked: DataFrame) -> DataFrame:
    """Adds time, distance and speed since the previous point (NULL without time between them)."""
    return (tracked.withColumn("dt_sec", F.expr(_DT))
            .withColumn("km", F.expr(f"if(dt_sec > 0, {_KM}, NULL)"))
            .withColumn("kmh", F.expr("km / (dt_sec / 3600)")))


def legs(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """One row per pair of consecutive movement points with time between them."""
    return legs_of(track(points, keys, chunk_sec), keys)


def legs_of(tracked: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    rows = measured(tracked).filter("dt_sec > 0")
    return rows.select(
        *keys, "ord", "ts_sec", "dt_sec", "km", "kmh", geo.plausible("kmh").alias("counted"),
        calendar.utc_day("ts_sec").alias("day"), geo.speed_mode("kmh").alias("mode"))


def gap_flags(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Why the track breaks at a point (time gap, standing still, implausible jump), and its journey number."""
    m = measured(track(points, keys, chunk_sec))
    moved = F.coalesce(F.col("dt_sec") > 0, F.lit(False))
    return m.select(
        *keys, "ord", "ts_sec",
        (moved & (F.col("dt_sec") > JOURNEY_GAP_SEC)).alias("time_gap"),
        (moved & (F.col("kmh") < STATIONARY_KMH)).alias("stationary"),
        (moved & (F.col("kmh") > PLAUSIBLE_MAX_KMH)).alias("jump"),
        "journey_no")


def speed_mode_km(leg_rows: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return leg_rows.filter("counted").groupBy(*keys, "mode").agg(F.sum("km").alias("km"))


def activities_or_heuristic(points: DataFrame, activities: DataFrame, keys: Keys = SUBJECT,
                            leg_rows: DataFrame | None = None) -> DataFrame:
    """km per mode and key: the stated activity distances where a key has any, else speed classes."""
    return stated_or(speed_mode_km(legs(points, keys) if leg_rows is None else leg_rows, keys), activities, keys)


def stated_or(guessed: DataFrame, activities: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """km per mode and key: stated where the key has activities, else guessed."""
    stated = activities.groupBy(*keys, "mode").agg((F.sum("distance_m") / 1000).alias("km"))
    guessed = guessed.join(stated.select(*keys).distinct(), list(keys), "left_anti")
    return (stated.withColumn("labelled", F.lit(True))
            .unionByName(guessed.withColumn("labelled", F.lit(False))))


def km_by_mode(points: DataFrame, activities: DataFrame, keys: Keys = SUBJECT,
               leg_rows: DataFrame | None = None) -> DataFrame:
    """Four rows per key that has points or activities, zeros kept, with the provenance flag."""
    totals = activities_or_heuristic(points, activities, keys, leg_rows)
    return _all_modes(points.select(*keys), activities, totals, keys)


def km_by_mode_of(present: DataFrame, activities: DataFrame, guessed: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The same from the keys that have points and their km by speed class."""
    return _all_modes(present.select(*keys), activities, stated_or(guessed, activities, keys), keys)


def _all_modes(present: DataFrame, activities: DataFrame, totals: DataFrame, keys: Keys) -> DataFrame:
    known = (present.unionByName(activities.select(*keys)).distinct()
             .join(activities.select(*keys, F.lit(True).alias("labelled")).distinct(), list(keys), "left"))
    grid = known.select(*keys, F.coalesce("labelled", F.lit(False)).alias("labelled"),
                        F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    return (grid.join(totals.select(*keys, "mode", "km"), [*keys, "mode"], "left")
            .withColumn("km", F.coalesce("km", F.lit(0.0))))


def total_km(mode_km: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return mode_km.groupBy(*keys).agg(F.sum("km").alias("total_km"))


def km_by_day(leg_rows: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return leg_rows.filter("counted").groupBy(*keys, "day").agg(F.sum("km").alias("km"))


def farthest_day(day_km: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The day with most km; the earliest on ties."""
    best = F.max_by(F.struct("day", "km"), F.struct(F.col("km"), -F.unix_date(F.to_date("day"))))
    return day_km.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.day", "b.km")


def journeys_of(tracked: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    counted = (F.col("kmh") >= STATIONARY_KMH) & (F.col("kmh") <= PLAUSIBLE_MAX_KMH)
    return (measured(tracked).groupBy(*keys, "journey_no")
            .agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"),
                 F.sum(F.when(counted, F.col("km"))).alias("km"))
            .filter("km > 0")
            .withColumn("duration_sec", F.col("end_sec") - F.col("start_sec")))


def journeys(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Unbroken runs of movement with distance, start, end and duration."""
    return journeys_of(track(points, keys, chunk_sec), keys)


def longest_journey(journey_rows: DataFrame, trips: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The longest journey (first on ties); a stated trip replaces it only when strictly longer."""
    columns = [*keys, "km", "start_sec", "end_sec", "duration_sec"]
    walked = journey_rows.select(*columns, F.lit(False).alias("from_trip"), F.col("start_sec").alias("_seq"))
    stated = trips.select(*keys, F.col("distance_from_origin_km").alias("km"), "start_sec", "end_sec",
                          (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
                          F.lit(True).alias("from_trip"), F.col("start_sec").alias("_seq"))
    rank = F.struct(F.col("km"), (~F.col("from_trip")).cast("int"), -F.col("_seq"))
    best = F.max_by(F.struct(*columns[len(keys):], "from_trip"), rank)
    return walked.unionByName(stated).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
