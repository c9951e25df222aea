"""The profile from monthly states against the single operators on points exploded to their periods."""

import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import movement, patterns, places, selection, stays
from sojourn.plans import profile

T = 1_703_000_000  # 19 December 2023
DAY = 86_400
ACTIVITIES = "subject_id string, start_sec bigint, end_sec bigint, distance_m double, mode string, raw_type string"
TRIPS = "subject_id string, start_sec bigint, end_sec bigint, distance_from_origin_km double"


def track(seed, subject, kinds):
    """Spells of rest and of travel over some months; ``kinds`` gives the source of the points by calendar month (0 = December)."""
    rng, rows, t, lat, lng = random.Random(seed), [], T, 50.0, 30.0
    while t < T + 75 * DAY:
        month = sum(t >= T + d * DAY for d in (13, 44, 73))
        source = kinds[month] or rng.choice(["movement", "visit"])
        if rng.random() < 0.5:
            for _ in range(rng.randrange(3, 25)):
                t += rng.choice([60, 120, 300])
                rows.append((t, lat + rng.random() * 3e-4, lng + rng.random() * 3e-4, source, rng.choice([None, "HOME"]), subject))
        else:
            for _ in range(rng.randrange(2, 12)):
                t += rng.choice([0, 60, 90, 1_600])
                lat, lng = lat + rng.uniform(-8e-3, 8e-3), lng + rng.uniform(-8e-3, 8e-3)
                rows.append((t, lat, lng, source, None, subject))
        t += rng.choice([0, 30, 3_000, 40_000])
        if abs((t - T) % DAY - 12_400) < 9_000 and rng.random() < 0.5:
            lat, lng = 50.0, 30.0
    # Rest over the turn of the year and over the end of January, in every zone.
    for d in (12, 43):
        begin = T + d * DAY
        rows = [r for r in rows if not begin <= r[0] < begin + 300 * 240]
        rows += [(begin + 240 * i, 50 + rng.random() * 3e-4, 30 + rng.random() * 3e-4, "visit", "HOME", subject) for i in range(300)]
    return rows


@pytest.mark.parametrize("tz", ["Asia/Kathmandu"])
def test_profile_equals_operators_on_exploded_points(spark, make_points, tz):
    kinds = {"a": [None] * 4, "b": ["visit"] * 4, "c": ["visit", "movement", "visit", "movement"], "d": ["visit", None, None, "visit"]}
    points = make_points([r for i, (s, k) in enumerate(kinds.items()) for r in track(i, s, k)])
    activities = spark.createDataFrame([("a", T + DAY, T + DAY + 9, 1500.0, "walk", "WALKING"), ("none", T + 20 * DAY, T + 20 * DAY + 60, 900.0, "drive", "X")], ACTIVITIES)
    trips = spark.createDataFrame([("a", T + 50 * DAY, T + 51 * DAY, 900.0), ("only", T, T + 5, 7.0)], TRIPS)
    frequent = spark.createDataFrame([], "subject_id string, ord bigint, lat double, lng double, label string")
    got = profile.run_all(points, activities, trips, frequent, tz=tz)
    keys = profile.PERIOD_KEYS
    exploded, acts = selection.period_explode(points, tz), selection.period_explode(activities, tz, "start_sec")
    tracked = movement.track(exploded, keys)
    legs = movement.legs_of(tracked, keys)
    runs = movement.journeys_of(tracked, keys)
    want = {
        "spans": patterns.span_days(exploded, keys), "mode_km": movement.km_by_mode(exploded, acts, keys, legs),
        "day_km": movement.km_by_day(legs, keys), "journeys": runs.drop("journey_no"),
        "longest_journey": movement.longest_journey(runs, selection.period_explode(trips, tz, "start_sec"), keys),
        "stays": places.clustered_stays(stays.stay_points(exploded, keys), keys),
        "footprint": patterns.footprint_month(exploded, keys), "coverage": patterns.coverage(exploded, keys),
        "hours": patterns.time_by_hour(exploded, keys, tz), "weekdays": patterns.time_by_weekday(exploded, keys, tz),
        "busiest": patterns.busiest(exploded, keys, tz)}
    for name, frame in want.items():
        columns = sorted(frame.columns)

        def rows(df):
            return sorted(([round(x, 6) if isinstance(x, float) else x for x in r] for r in df.select(columns).collect()), key=repr)

        assert rows(getattr(got, name)) == rows(frame), name
    summary = {(r.subject_id, r.period_key): r for r in got.summary().collect()}
    assert summary["none", "y2024m01"].total_km == pytest.approx(0.9) and summary["none", "all"].point_count == 0
    assert summary["only", "all"].longest_journey_km == 7.0 and summary["only", "all"].total_km == 0.0
    assert {k for s, k in summary if s == "b"} == {"all", "y2023", "y2024", "y2023m12", "y2024m01", "y2024m02", "y2024m03"}
    crossing = got.stays.filter("subject_id = 'a' AND period_key = 'all'").filter(
        F.date_trunc("month", F.timestamp_seconds("start_sec")) < F.date_trunc("month", F.timestamp_seconds("end_sec")))
    assert crossing.count() >= 1


def test_profile_without_periods(spark, make_points):
    points = make_points(track(9, "a", [None] * 4))
    none = spark.createDataFrame([], ACTIVITIES), spark.createDataFrame([], TRIPS)
    frequent = spark.createDataFrame([], "subject_id string, ord bigint, lat double, lng double, label string")
    whole = profile.run_all(points, *none, frequent, by_period=False).summary().collect()
    parts = profile.run_all(points, *none, frequent).summary().filter("period_key = 'all'").drop("period_key").collect()
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in whole] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in parts]


def test_tables_are_made_only_when_asked_for(spark, make_points, monkeypatch):
    def asked(*_):
        raise AssertionError("stays were not asked for")

    monkeypatch.setattr(profile, "_stays", asked)
    none = spark.createDataFrame([], ACTIVITIES), spark.createDataFrame([], TRIPS)
    frequent = spark.createDataFrame([], "subject_id string, ord bigint, lat double, lng double, label string")
    got = profile.run_all(make_points([(T + 60 * i, 50 + i / 100, 30.0) for i in range(3)]), *none, frequent)
    assert [r.duration_sec for r in got.journeys.collect()] == [120] * 3
    with pytest.raises(AssertionError, match="not asked for"):
        got.summary()


def test_activities_are_summed_before_they_meet_their_periods(spark, make_points):
    activities = spark.createDataFrame([("a", T + 60 * i, T + 60 * i + 9, 100.0, "walk", "WALKING") for i in range(50)], ACTIVITIES)
    frequent = spark.createDataFrame([], "subject_id string, ord bigint, lat double, lng double, label string")
    got = profile.run_all(make_points([(T, 50.0, 30.0)]), activities, spark.createDataFrame([], TRIPS), frequent)
    assert got._activities.count() == 3
    assert {(r.period_key, r.km) for r in got.mode_km.filter("mode = 'walk'").collect()} == {(p, 5.0) for p in ("all", "y2023", "y2023m12")}
