"""The whole profile of every history and period from one read of the source.

A period's results are those of its own rows, as if nothing else were known. Most of them come from *states by person and
month* that are merged into years and the whole history, so points are never multiplied by their periods:

* counts, spans, boxes and sums by weekday and hour, merged as they are;
* distances of points from three centres, and cells of three boxes, in one pass over the points;
* legs of one time-ordered scan. A leg that enters a month counts for its year and the whole, one that enters a year for the
  whole only. A month or year without movement points uses all its rows, as a track of its own; a row is in one track;
* journeys as pieces by month, merged by their number;
* stays of islands of the track. An island inside one month has the same stays in all three periods. Only islands that cross
  months are scanned again, cut by month and by year.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sojourn.constants import PLAUSIBLE_MAX_KMH, STATIONARY_KMH
from sojourn.functions import calendar, geo
from sojourn.operators import movement, patterns, places, selection, stays
from sojourn.operators.ordered import CHUNK, Keys, scan, with_time_chunk
from sojourn.operators.staging import staged, staged_table

PERIOD_KEYS = ("subject_id", "period_key")
_ALL = "all"
_LEVELS = ("all", "year", "month")


class Profile:
    """Lazy tables, all keyed by ``keys``. A table, and every step that tables share, is made once and only if it is asked for."""

    def __init__(self, points: DataFrame, activities: DataFrame, trips: DataFrame, frequent_places: DataFrame, by_period: bool, tz: str,
                 chunk_sec: int | None):
        self._points, self._trips, self._frequent = points, trips, frequent_places
        self._given, self._tz, self._chunk_sec = activities, tz, chunk_sec
        self._at = _Months(by_period)
        self.keys: tuple[str, ...] = self._at.keys

    # Steps that tables share.

    @cached_property
    def _rows(self) -> DataFrame:
        months = calendar.period_keys("ts_sec", self._tz)[2].alias("month"), calendar.utc_month("ts_sec").alias("utc_month")
        source = staged_table(self._points.select("subject_id", "ord", "lat", "lng", "ts_sec", "source", "semantic_label", *months))
        return with_time_chunk(source, ("subject_id",), self._chunk_sec)

    @cached_property
    def _slots(self) -> DataFrame:
        weekday, hour = calendar.local_weekday("ts_sec", self._tz), calendar.local_hour("ts_sec", self._tz)
        return staged(self._rows.groupBy("subject_id", "month", "utc_month", weekday.alias("weekday"), hour.alias("hour")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("ts_sec").alias("first_sec"), F.max("ts_sec").alias("last_sec"),
            F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
            F.min("lng").alias("lng0"), F.max("lng").alias("lng1"),
            F.max(F.coalesce(F.col("source") == "movement", F.lit(False))).alias("moves")))

    @cached_property
    def _periods(self) -> DataFrame:
        return self._at.spread(self._slots)

    @cached_property
    def _placed(self) -> DataFrame:
        return _placed(self._rows, self._slots, self._at)

    @cached_property
    def _tracked(self) -> DataFrame:
        return staged_table(_tracked(self._placed))

    @cached_property
    def _legs(self) -> DataFrame:
        return _legs(self._tracked)

    @cached_property
    def _leg_km(self) -> DataFrame:
        km = self._legs.filter("counted").groupBy("subject_id", "track", "month", "enters", "mode", "day").agg(F.sum("km").alias("km"))
        return staged(self._at.spread(km, km=_reached("km")).groupBy(*self.keys, "mode", "day").agg(F.sum("km").alias("km")))

    @cached_property
    def _activities(self) -> DataFrame:
        """Stated distances by key and mode; summed by month before they meet their periods."""
        if not self._at.by_period:
            return self._given
        sums = self._given.groupBy("subject_id", calendar.period_keys("start_sec", self._tz).alias("_p"), "mode").agg(F.sum("distance_m").alias("distance_m"))
        return staged(sums).withColumn("period_key", F.explode("_p")).drop("_p")

    # The tables.

    @cached_property
    def spans(self) -> DataFrame:
        return self._periods.groupBy(*self.keys).agg(
            F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"),
            ((F.max("last_sec") - F.min("first_sec")) / 86400).alias("span_days"), F.sum("cnt").alias("point_count"))

    @cached_property
    def hours(self) -> DataFrame:
        return patterns.dense_counts(self._periods.groupBy(*self.keys, "hour").agg(F.sum("cnt").alias("cnt")), self.keys, "hour", 24)

    @cached_property
    def weekdays(self) -> DataFrame:
        return patterns.dense_counts(self._periods.groupBy(*self.keys, "weekday").agg(F.sum("cnt").alias("cnt")), self.keys, "weekday", 7)

    @cached_property
    def busiest(self) -> DataFrame:
        return patterns.busiest_of(self._periods, self.keys)

    @cached_property
    def mode_km(self) -> DataFrame:
        guessed = self._leg_km.groupBy(*self.keys, "mode").agg(F.sum("km").alias("km"))
        return movement.km_by_mode_of(self.spans, self._activities, guessed, self.keys)

    @cached_property
    def day_km(self) -> DataFrame:
        return self._leg_km.groupBy(*self.keys, "day").agg(F.sum("km").alias("km"))

    @cached_property
    def journeys(self) -> DataFrame:
        return _journeys(self._legs, self._tracked, self._at)

    @cached_property
    def longest_journey(self) -> DataFrame:
        trips = selection.period_explode(self._trips, self._tz, "start_sec") if self._at.by_period else self._trips
        return movement.longest_journey(self.journeys, trips, self.keys)

    @cached_property
    def stays(self) -> DataFrame:
        return places.clustered_stays(stays.numbered(_stays(self._rows, self._tz, self._at), self.keys), self.keys)

    @cached_property
    def places(self) -> DataFrame:
        built = places.nearest_frequent_place(places.place_build(self.stays, self.keys), self._frequent, self.keys)
        return staged(places.place_rank(places.place_lifecycle(built, self.spans, self.keys), self.keys))

    @cached_property
    def footprint(self) -> DataFrame:
        return _footprint(self._placed, self._slots, self._at)

    @cached_property
    def coverage(self) -> DataFrame:
        return _coverage(self._placed, self._at)

    def summary(self) -> DataFrame:
        """One row per key that has points, activities or trips; without points it counts none and spans no days."""
        k = list(self.keys)
        # What follows the slots are three chains that share nothing; clustering is many small jobs, so the others fill the cores meanwhile.
        self.spans, self._placed
        with ThreadPoolExecutor(3) as pool:
            chains = [pool.submit(inheritable_thread_target(self._rows.sparkSession)(make))
                      for make in (lambda: self.places, lambda: self._leg_km, lambda: staged(self.coverage.select(*k, "coverage_ratio")))]
            cover = [c.result() for c in chains][-1]
        far = movement.farthest_day(self.day_km, k).select(*k, F.col("day").alias("farthest_day"),
                                                           F.col("km").alias("farthest_day_km"))
        longest = self.longest_journey.select(*k, F.col("km").alias("longest_journey_km"))
        count = self.places.groupBy(*k).agg(F.count(F.lit(1)).alias("place_count"))
        total = movement.total_km(self.mode_km, k)
        hours = self.busiest.select(*k, "busiest_hour")
        out = total.select(*k).unionByName(longest.select(*k)).distinct().join(self.spans.select(*k, "point_count", "span_days"), k, "left")
        for part in (total, far, longest, count, cover, hours):
            out = out.join(part, k, "left")
        return out.fillna(0, ["place_count", "point_count"]).fillna(0.0, ["span_days", "total_km"])


class _Months:
    """Columns that lead from a person's month to the periods it belongs to."""

    def __init__(self, by_period: bool):
        self.by_period = by_period
        self.keys: tuple[str, ...] = PERIOD_KEYS if by_period else ("subject_id",)

    def key(self, level: str, month: str = "month") -> Column:
        return {"all": F.lit(_ALL), "year": F.substring(month, 1, 5), "month": F.col(month)}[level]

    def spread(self, df: DataFrame, **values: dict[str, Column]) -> DataFrame:
        """Each row once for each of its periods. A value is given by level; a null one of all values keeps the row out."""
        levels = _LEVELS if self.by_period else _LEVELS[:1]
        rows = F.array(*[F.struct(self.key(level).alias("period_key"), *[v[level].alias(n) for n, v in values.items()]) for level in levels])
        out = df.withColumn("_p", F.explode(rows)).select(*[c for c in df.columns if c not in values], "_p.*")
        for n in values:
            out = out.filter(F.col(n).isNotNull())
        return out

    def over(self, level: str) -> Column:
        return Window.partitionBy("subject_id", self.key(level))


def run_all(points: DataFrame, activities: DataFrame, trips: DataFrame, frequent_places: DataFrame,
            by_period: bool = True, tz: str = "UTC", chunk_sec: int | None = None) -> Profile:
    """Everything the engine computes, per subject or per subject and period."""
    return Profile(points, activities, trips, frequent_places, by_period, tz, chunk_sec)


def _placed(rows: DataFrame, slots: DataFrame, at: _Months) -> DataFrame:
    """``rows`` with what their periods know: centres, grids and the track that a row belongs to (if it does)."""
    months = slots.groupBy("subject_id", "month", "utc_month").agg(
        *[F.sum(c).alias(c) for c in ("cnt", "lat_sum", "lng_sum")], *[F.min(c).alias(c) for c in ("lat0", "lng0")],
        *[F.max(c).alias(c) for c in ("lat1", "lng1", "moves")])
    for level in _LEVELS:
        wide = at.over(level)
        inside = Window.partitionBy("subject_id", at.key(level), "utc_month")
        box = {c: F.min(c).over(wide) if c.endswith("0") else F.max(c).over(wide) for c in ("lat0", "lat1", "lng0", "lng1")}
        months = months.withColumns({
            f"centre_{level}": F.struct((F.sum("lat_sum").over(inside) / F.sum("cnt").over(inside)).alias("lat"),
                                        (F.sum("lng_sum").over(inside) / F.sum("cnt").over(inside)).alias("lng")),
            f"box_{level}": F.struct(*[v.alias(c) for c, v in box.items()]), f"moves_{level}": F.max("moves").over(wide)})
    for level in _LEVELS:
        grid = patterns.with_grid(months.select("subject_id", "month", "utc_month", f"box_{level}.*"))
        grid = grid.select("subject_id", "month", "utc_month", F.struct("lat0", "lng0", "size", "grid_cols", "grid_rows").alias(f"grid_{level}"))
        months = months.join(grid, ["subject_id", "month", "utc_month"])
    track = F.lit(_ALL)
    if at.by_period:
        track = (F.when(~F.col("moves_all") | F.col("moves_month"), F.lit(_ALL)).when(F.col("moves_year"), F.col("month"))
                 .otherwise(at.key("year")))
    known = months.select("subject_id", "month", "utc_month", track.alias("track"),
                          ((track == _ALL) & F.col("moves_all")).alias("moves_only"), *[f"{c}_{level}" for c in ("centre", "grid") for level in _LEVELS])
    # A chunk lies inside one UTC day, so rows meet their months by chunk and not by person.
    chunks = rows.select("subject_id", CHUNK, "month", "utc_month").distinct().join(staged(known), ["subject_id", "month", "utc_month"])
    return rows.join(chunks, ["subject_id", CHUNK, "month", "utc_month"])


def _tracked(placed: DataFrame) -> DataFrame:
    moving = placed.filter("NOT moves_only OR source = 'movement'").select("subject_id", "track", CHUNK, "ord", *movement.TRACK, "month")
    return scan(moving, ("subject_id", "track"), (*movement.TRACK, "month"), {"journey_no": movement.JOURNEY_BREAKS})


def _legs(tracked: DataFrame) -> DataFrame:
    """Measured legs; ``enters`` is the narrowest period that the leg's first point is not in: nothing, its month or its year."""
    enters = (F.when(F.col("month") == F.col("prev_month"), F.lit("")).when(F.substring("month", 1, 5) == F.substring("prev_month", 1, 5), F.lit("month"))
              .otherwise(F.lit("year")))
    return movement.measured(tracked).select(
        "subject_id", "track", "month", "journey_no", "ts_sec", "km", "kmh", "dt_sec", enters.alias("enters"), geo.plausible("kmh").alias("counted"),
        calendar.utc_day("ts_sec").alias("day"), geo.speed_mode("kmh").alias("mode")).filter("dt_sec > 0")


def _in_track(level: str) -> Column:
    """Whether a period of the level uses the row's track."""
    return {"all": F.col("track") == _ALL, "year": F.length("track") <= 5, "month": F.lit(True)}[level]


def _reached(km: str) -> dict[str, Column]:
    """The km by level, null where the leg is not of the period."""
    reach = {"all": F.lit(True), "year": F.col("enters") != "year", "month": F.col("enters") == ""}
    return {level: F.when(_in_track(level) & reach[level], F.col(km)) for level in _LEVELS}


def _journeys(legs: DataFrame, tracked: DataFrame, at: _Months) -> DataFrame:
    own = ["subject_id", "track", "journey_no", "month"]
    rides = (F.col("kmh") >= STATIONARY_KMH) & (F.col("kmh") <= PLAUSIBLE_MAX_KMH)
    km = {n: F.sum(F.when(F.col("enters") == e, F.col("km"))) for n, e in (("within", ""), ("into_month", "month"), ("into_year", "year"))}
    pieces = tracked.groupBy(*own).agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"))
    pieces = pieces.join(legs.filter(rides).groupBy(*own).agg(*[v.alias(n) for n, v in km.items()]), own, "left")
    sums = {"month": F.coalesce("within", F.lit(0.0))}
    sums["year"] = sums["month"] + F.coalesce("into_month", F.lit(0.0))
    sums["all"] = sums["year"] + F.coalesce("into_year", F.lit(0.0))
    spread = at.spread(pieces, km={level: F.when(_in_track(level), v) for level, v in sums.items()})
    merged = spread.groupBy(*at.keys, "track", "journey_no").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("km").alias("km"))
    return merged.drop("track").filter("km > 0").withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))


def _footprint(placed: DataFrame, slots: DataFrame, at: _Months) -> DataFrame:
    def squares(level: str) -> Column:
        d = F.expr(geo.haversine_sql("lat", "lng", f"centre_{level}.lat", f"centre_{level}.lng"))
        return F.sum(d * d).alias(f"d_{level}")

    sums = placed.groupBy("subject_id", "month", "utc_month").agg(F.count(F.lit(1)).alias("n"), *[squares(level) for level in _LEVELS])
    sums = at.spread(sums, d={level: F.col(f"d_{level}") for level in _LEVELS})
    sums = sums.groupBy(*at.keys, "utc_month").agg(F.sum("n").alias("point_count"), (F.sqrt(F.sum("d") / F.sum("n")) / 1000).alias("radius_of_gyration_km"))
    centres = at.spread(slots).groupBy(*at.keys, "utc_month").agg(*[F.sum(c).alias(c) for c in ("cnt", "lat_sum", "lng_sum")])
    ever = Window.partitionBy(*at.keys)
    centres = centres.select(*at.keys, "utc_month", *[(F.col(f"{c}_sum") / F.col("cnt")).alias(f"centroid_{c}") for c in ("lat", "lng")],
                             *[(F.sum(f"{c}_sum").over(ever) / F.sum("cnt").over(ever)).alias(f"_e_{c}") for c in ("lat", "lng")])
    shift = geo.haversine_m("centroid_lat", "centroid_lng", "_e_lat", "_e_lng") / 1000
    return sums.join(centres.withColumn("shift_from_overall_km", shift), [*at.keys, "utc_month"]).select(
        *at.keys, F.col("utc_month").alias("month"), "centroid_lat", "centroid_lng", "radius_of_gyration_km", "shift_from_overall_km", "point_count")


def _coverage(placed: DataFrame, at: _Months) -> DataFrame:
    def cell(level: str) -> Column:
        g = F.col(f"grid_{level}")
        return F.struct(patterns.grid_row(F.col("lat"), g["lat0"], g["size"], g["grid_rows"]).alias("row"),
                        patterns.grid_row(F.col("lng"), g["lng0"], g["size"], g["grid_cols"]).alias("col"),
                        g["grid_cols"].alias("grid_cols"), g["grid_rows"].alias("grid_rows"))

    cells = placed.select("subject_id", "month", *[cell(level).alias(f"cell_{level}") for level in _LEVELS]).distinct()
    seen = at.spread(cells, cell={level: F.col(f"cell_{level}") for level in _LEVELS}).select(*at.keys, "cell.*").distinct()
    return patterns.coverage_of(seen, at.keys)


def _stays(rows: DataFrame, tz: str, at: _Months) -> DataFrame:
    """Stays by person and period, each island scanned once if it lies in one month."""
    tracks = stays.islands(rows, ("subject_id",))
    if not at.by_period:
        return stays.stays_of_islands(staged_table(tracks), ("subject_id",))
    tracks = tracks.withColumn("month", calendar.period_keys("ts_sec", tz)[2])
    tracks = staged_table(tracks)
    # Most islands lie in one month. The others are found by (island, chunk), and only their rows are dealt to more than one unit.
    crossing = tracks.groupBy("subject_id", "island").agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a < b")
    chunks = tracks.select("subject_id", "island", CHUNK).distinct().join(crossing.select("subject_id", "island", F.lit(True).alias("crosses")), ["subject_id", "island"])
    marked = tracks.join(staged(chunks), ["subject_id", "island", CHUNK], "left")
    units = F.when(F.col("crosses"), F.array(*[at.key(level) for level in _LEVELS])).otherwise(F.array(F.lit("")))
    dealt = staged_table(marked.withColumn("unit", F.explode(units)).drop("crosses", "month"))
    found = stays.stays_of_islands(dealt, ("subject_id", "unit"))
    own = F.when(F.col("unit") == "", calendar.period_keys("start_sec", tz)).otherwise(F.array("unit"))
    return found.withColumn("period_key", F.explode(own)).drop("unit")


def headline(points: DataFrame, place_rows: DataFrame, keys: Keys = ("subject_id",)) -> DataFrame:
    """Number of points, days spanned, number of significant places."""
    chosen = selection.significant_places(place_rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("place_count"))
    return (patterns.span_days(points, keys).select(*keys, "point_count", "span_days")
            .join(chosen, list(keys), "left").withColumn("place_count", F.coalesce("place_count", F.lit(0))))
