"""Boundary cases, one hand-made table each."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sojourn.functions import calendar, geo, lookups, text
from sojourn.operators import enrichment, maplayers, movement, patterns, places, selection, stays

T = 1_704_103_200  # 2024-01-01 10:00 UTC
M_LAT = 1 / (math.radians(1) * 6_371_000)  # degrees of latitude per metre


def north(m):
    return 50 + m * M_LAT


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("span, found", [(599, 0), (600, 1)])
def test_stay_needs_ten_minutes(make_points, span, found):
    assert stays.stay_points(make_points([(T, 50, 30), (T + span, 50, 30)])).count() == found


@pytest.mark.parametrize("meters, size", [(99.99, 3), (100.01, 2)])
def test_stay_radius_is_measured_from_the_anchor(make_points, meters, size):
    r = one(stays.stay_points(make_points([(T, 50, 30), (T + 700, north(50), 30), (T + 900, north(meters), 30)])))
    assert r.point_count == size


@pytest.mark.parametrize("gap, found", [(7200, 1), (7201, 0)])
def test_stay_breaks_at_a_long_silence(make_points, gap, found):
    assert stays.stay_points(make_points([(T, 50, 30), (T + gap, 50, 30)])).count() == found


def test_slow_drift_cannot_stretch_a_stay(make_points):
    drift = [(T + i * 300, north(60 * i), 30) for i in range(20)]
    assert all(r.end_sec - r.start_sec <= 600 for r in stays.stay_points(make_points(drift)).collect())


def test_label_tie_goes_to_the_first_seen(make_points):
    rows = [(T + 100 * i, 50, 30, "visit", label) for i, label in enumerate(["WORK", "HOME", "HOME", "WORK", None, "", "", ""])]
    assert one(stays.stay_points(make_points(rows))).semantic_label == "WORK"


def test_duplicate_times_make_no_leg(make_points):
    legs = movement.legs(make_points([(T, 50, 30), (T, north(500), 30), (T + 60, north(600), 30)])).collect()
    assert len(legs) == 1 and legs[0].km == pytest.approx(0.1, abs=1e-6)


def test_leg_over_a_long_gap_starts_and_feeds_a_new_journey(make_points):
    walk = [(T, 50, 30), (T + 60, north(100), 30), (T + 60 + 1560, north(100 + 2166), 30)]
    rows = movement.journeys(make_points(walk)).orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec) for r in rows] == [(T, T + 60), (T + 1620, T + 1620)]
    assert rows[1].km == pytest.approx(2.166, abs=1e-6)


def test_implausible_leg_neither_counts_nor_breaks(make_points):
    pts = make_points([(T, 50, 30), (T + 60, north(100), 30), (T + 120, north(100 + 4200), 30), (T + 180, north(4400), 30)])
    assert one(movement.journeys(pts)).km == pytest.approx(0.2, abs=1e-6)
    assert one(movement.km_by_day(movement.legs(pts))).km == pytest.approx(0.2, abs=1e-6)
    assert maplayers.routes(pts, min_points=1).select("segment_id").distinct().count() == 2


def test_slow_and_far_legs_count_per_day_but_not_per_journey(make_points):
    pts = make_points([(T, 50, 30), (T + 3600, north(1000), 30)])
    assert one(movement.km_by_day(movement.legs(pts))).km == pytest.approx(1.0, abs=1e-6)
    assert movement.journeys(pts).count() == 0


def test_trip_replaces_a_journey_only_when_longer(spark, make_points):
    pts = make_points([(T, 50, 30), (T + 600, north(1000), 30)])
    runs = movement.journeys(pts)
    km = one(runs).km
    for stated, from_trip in ((km, False), (km + 1, True)):
        trips = spark.createDataFrame([("a", T, T + 9, stated)], "subject_id string, start_sec bigint, end_sec bigint, distance_from_origin_km double")
        assert one(movement.longest_journey(runs, trips)).from_trip is from_trip


def test_modes_fall_back_to_speed_per_person(spark, make_points):
    pts = make_points([(T, 50, 30), (T + 600, north(900), 30), (T, 50, 30, "movement", None, "b"), (T + 600, north(900), 30, "movement", None, "b")])
    acts = spark.createDataFrame([("b", T, T + 1, 5000.0, "drive")], "subject_id string, start_sec bigint, end_sec bigint, distance_m double, mode string")
    got = {(r.subject_id, r["mode"]): (round(r.km, 3), r.labelled) for r in movement.km_by_mode(pts, acts).collect()}
    assert len(got) == 8 and got["a", "walk"] == (0.9, False) and got["b", "drive"] == (5.0, True) and got["b", "walk"] == (0.0, True)


def test_visits_only_history_uses_all_points(make_points):
    pts = make_points([(T, 50, 30, "visit"), (T + 60, 50, 30, "visit"), (T, 50, 30, "visit", None, "b"), (T, 50, 30, "movement", None, "b")])
    counts = {r.subject_id: r["count"] for r in selection.movement_points(pts).groupBy("subject_id").count().collect()}
    assert counts == {"a": 2, "b": 1}


def visits(spots):
    return [(T + 86400 * d + 900 * i, lat, lng) for d, (lat, lng) in enumerate(spots) for i in range(2)]


@pytest.mark.parametrize("n, found", [(3, 0), (4, 1)])
def test_a_place_needs_four_visits(make_points, n, found):
    clustered = places.clustered_stays(stays.stay_points(make_points(visits([(50, 30)] * n))))
    assert places.place_build(clustered).count() == found


@pytest.mark.parametrize("meters, label", [(119.9, "HOME"), (120.1, None)])
def test_frequent_place_radius(spark, meters, label):
    place = spark.createDataFrame([("a", 0, 50.0, 30.0, None)], "subject_id string, cluster_id int, lat double, lng double, semantic_label string")
    known = spark.createDataFrame([("a", 2, north(meters), 30.0, "HOME"), ("a", 1, north(-meters - 0.1), 30.0, "WORK"), ("b", 0, 50.0, 30.0, "X"),
                                   ("a", 0, 50.0, 30.0, None)], "subject_id string, ord int, lat double, lng double, label string")
    assert one(places.nearest_frequent_place(place, known)).semantic_label == label


@pytest.mark.parametrize("days, gone, fresh", [(30, 15, 15), (3650, 181, 181)])
def test_lifecycle_window_is_clamped(spark, days, gone, fresh):
    end = T + days * 86400
    rows = [("a", 0, T, end - gone * 86400, 4), ("a", 1, T + fresh * 86400, end, 4), ("a", 2, T, end, 4), ("a", 3, T, T + 9, 3),
            ("a", 4, T, end - (gone - 1) * 86400, 4)]
    frame = spark.createDataFrame(rows, "subject_id string, cluster_id int, first_seen_sec bigint, last_seen_sec bigint, visit_count bigint")
    spans = spark.createDataFrame([("a", T, end)], "subject_id string, first_sec bigint, last_sec bigint")
    got = {r.cluster_id: r.lifecycle for r in places.place_lifecycle(frame, spans).collect()}
    assert got == {0: "abandoned", 1: "new", 2: None, 3: None, 4: None}


def test_heat_scale_guards(make_points):
    single = one(maplayers.heat_scale(make_points([(T + i, 50, 30) for i in range(9)])))
    assert single.floor_log == pytest.approx(math.log1p(9) / 2) and single.peak_log == pytest.approx(math.log1p(9))
    even = make_points([(T + i, 50 + 0.01 * (i % 4), 30) for i in range(40)])
    assert maplayers.heat_cells(even, maplayers.heat_scale(even)).count() == 4


def test_single_coordinate_bounds_and_coverage(make_points):
    pts = make_points([(T + i, 50, 30) for i in range(5)])
    b = one(maplayers.robust_bounds(pts))
    assert (b.min_lat, b.max_lat) == pytest.approx((49.999, 50.001)) and (b.min_lng, b.max_lng) == pytest.approx((29.999, 30.001))
    c = one(patterns.coverage(pts))
    assert (c.visited_cells, c.total_cells) == (1, 324)
    assert sum(one(patterns.coverage_array(patterns.coverage_grid(pts))).visited) == 1


def test_bounds_leave_outliers_out(make_points):
    pts = make_points([(T + i, 50 + i * 1e-4, 30 + i * 1e-4) for i in range(200)] + [(T + 900, 10, 10), (T + 901, -60, 170)])
    b = one(maplayers.robust_bounds(pts))
    assert b.min_lat > 49.9 and b.max_lng < 30.1


def test_thinning_keeps_short_segments_and_last_points(make_points):
    long = [(T + 60 * i, north(50 * i), 30) for i in range(21)]
    short = [(T + 9000 + 60 * i, north(50 * i), 31) for i in range(5)]
    got = maplayers.route_thin(maplayers.routes(make_points(long + short)), stride=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.segment_id, []).append(r.idx)
    assert [sorted(v) for _, v in sorted(by.items())] == [[0, 3, 6, 9, 12, 15, 18, 20], [0, 1, 2, 3, 4]]


def test_there_and_back_is_one_street(make_points):
    path = [(T + 60 * i, north(80 * i), 30) for i in range(4)] + [(T + 240 + 60 * i, north(80 * (3 - i)), 30) for i in range(1, 4)]
    edges = maplayers.route_density(maplayers.routes(make_points(path)))
    assert {r.passes for r in edges.collect()} == {2} and edges.count() == 3
    graded, levels = maplayers.route_levels(edges)
    assert one(levels).level == 5 and {r.level for r in graded.collect()} == {5}


def test_local_time_and_period_bounds(spark):
    assert calendar.period_bounds("all") is None
    assert calendar.period_bounds("y2024m01", "Europe/Kyiv") == (1704060000, 1706738400)
    assert calendar.period_bounds("y2023") == (1672531200, 1704067200)
    keys = spark.createDataFrame([("all",), ("y2024",), ("y2024m12",)], "k string")
    start, end = calendar.period_bound_columns("k", "Europe/Kyiv")
    got = {r.k: (r.s, r.e) for r in keys.select("k", start.alias("s"), end.alias("e")).collect()}
    assert got == {"all": (None, None), "y2024": calendar.period_bounds("y2024", "Europe/Kyiv"),
                   "y2024m12": calendar.period_bounds("y2024m12", "Europe/Kyiv")}
    late = spark.createDataFrame([(1704063600,)], "t bigint").select(
        calendar.period_keys("t", "Europe/Kyiv").alias("p"), calendar.local_hour("t", "Europe/Kyiv").alias("h"),
        calendar.local_weekday("t", "Europe/Kyiv").alias("w"), calendar.utc_month("t").alias("m")).first()
    assert late.p == ["all", "y2024", "y2024m01"] and (late.h, late.w, late.m) == (1, 0, "2023-12")


def test_calendar_ignores_the_session_time_zone(spark, make_points):
    pts = make_points([(1704063600, 50, 30)])
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        hours = {r.hour for r in patterns.time_by_hour(pts, tz="Europe/Kyiv").filter("cnt > 0").collect()}
        month = one(patterns.footprint_month(pts)).month
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert hours == {1} and month == "2023-12"


def test_empty_tables(spark, make_points):
    none = make_points([])
    assert stays.stay_points(none).count() == 0
    assert places.place_build(places.clustered_stays(stays.stay_points(none))).count() == 0
    assert movement.journeys(none).count() == 0 and maplayers.heat_scale(none).count() == 0
    assert patterns.coverage(none).count() == 0 and maplayers.robust_bounds(none).count() == 0


def test_breakdown_shares(spark):
    rows = [("a", 0, 30, "x", "N"), ("a", 1, 10, "x", "S"), ("a", 2, 60, None, ""), ("b", 0, 0, "y", "N")]
    geo_rows = spark.createDataFrame(rows, "subject_id string, cluster_id int, total_duration_sec bigint, category string, district string")
    cats = {(r.subject_id, r.category): (r.total_duration_sec, r.place_count) for r in enrichment.category_breakdown(geo_rows).collect()}
    assert cats == {("a", "x"): (40, 2), ("b", "y"): (0, 1)}
    shares = {(r.subject_id, r.district): r.share_of_known_time for r in enrichment.district_breakdown(geo_rows).collect()}
    assert shares == {("a", "N"): 0.75, ("a", "S"): 0.25, ("b", "N"): 0.0}


def test_scalar_rules(spark):
    rows = spark.createDataFrame([("50.45°, 30.52°", " Home ", "in_bus", "Crème  Brûlée!")], "a string, b string, c string, d string")
    r = rows.select(text.parse_latlng("a").alias("at"), text.normalise_label("b").alias("l"), lookups.travel_mode("c").alias("m"),
                    text.category_token("d").alias("t"), geo.scaled_key(F.lit(-50.12345)).alias("k")).first()
    assert (r["at"].lat, r["at"].lng, r.l, r.m, r.t, r.k) == (50.45, 30.52, "HOME", "transit", "creme_brulee", -501235)
    assert lookups.vocabulary(spark, "travel_mode").count() == 13 and lookups.vocabulary(spark, "category_label").count() == 33


def test_bounds_are_exact_ranks_of_all_rows(make_points):
    rng = random.Random(2)
    rows = [(T + i, 50 + rng.choice([0, 0, 0.0004, 0.002, 3]) + rng.random() * 1e-5, 30 + rng.random(), "movement", None, "ab"[i % 3 == 0]) for i in range(900)]
    got = {r.subject_id: r for r in maplayers.robust_bounds(make_points(rows)).collect()}
    for who in "ab":
        lat, lng = sorted(r[1] for r in rows if r[5] == who), sorted(r[2] for r in rows if r[5] == who)
        low, high = math.floor((len(lat) - 1) * 0.02), math.ceil((len(lat) - 1) * 0.98)
        assert (got[who].min_lat, got[who].max_lat, got[who].min_lng, got[who].max_lng) == (lat[low], lat[high], lng[low], lng[high])


def test_repeated_addresses_and_venues_count_once(spark):
    targets = spark.createDataFrame([("a", 0, 50.0, 30.0, 60)], "subject_id string, cluster_id int, lat double, lng double, total_duration_sec bigint")
    address = (500000, 300000, "B", "r", "1", "d", "cafe", None, None, None, None, None)
    addresses = spark.createDataFrame([address, (*address[:2], "A", *address[3:])],
                                      "lat_key bigint, lng_key bigint, name string, road string, house_number string, display_name string, type string,"
                                      " city_district string, borough string, suburb string, neighbourhood string, quarter string")
    assert [r.name for r in enrichment.address_lookup(targets, addresses).collect()] == ["A"]
    venues = spark.createDataFrame([(1, "\tV\u00a0", 50.0, 30.0, "Bank", " N\n")] * 2,
                                   "venue_id int, name string, lat double, lng double, categories string, neighborhood string")
    named = enrichment.two_tier_names(targets, venues, addresses).collect()
    assert [(r.name, r.district) for r in named] == [("V", "N")]


def test_people_with_activities_only_have_totals(spark, make_points):
    acts = spark.createDataFrame([("z", 0, 10, 2500.0, "walk", "WALKING")],
                                 "subject_id string, start_sec bigint, end_sec bigint, distance_m double, mode string, raw_type string")
    km = movement.km_by_mode(make_points([]), acts)
    assert {r["mode"]: (r.km, r.labelled) for r in km.collect()} == {"walk": (2.5, True), "transit": (0.0, True), "drive": (0.0, True), "other": (0.0, True)}


def test_all_white_space_is_trimmed(spark):
    rows = spark.createDataFrame([("\tHome\n",), ("\u00a0 home\ufeff",), (" \u2003",), (None,)], "a string")
    assert [r.l for r in rows.select(text.normalise_label("a").alias("l")).collect()] == ["HOME", "HOME", None, None]
