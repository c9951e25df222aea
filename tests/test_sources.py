"""Export files, JSON lines, tables and the streaming landing folder."""

import json

import pytest

from sojourn.operators import stays
from sojourn.sources import exports, tables
from sojourn.streaming.landing import append_points

SEGMENTS = [
    {"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-04T00:00:00Z",
     "visit": {"topCandidate": {"placeLocation": {"latLng": "50.1°, 30.1°"}, "semanticType": "HOME"}}},
    {"startTime": "2024-01-01T00:00:00.600Z", "visit": {"topCandidate": {"placeLocation": "geo:50.2,30.2", "semanticType": "UNKNOWN"}}},
    {"startTime": "2024-01-01T05:00:00+02:00", "endTime": "2024-01-01T04:00:00Z",
     "activity": {"start": {"latLng": "50.1°, 30.1°"}, "end": "95.0°, 1.0°", "distanceMeters": -5, "topCandidate": {"type": "cycling"}}},
    {"startTime": "2024-01-01T06:00:00Z", "timelinePath": [
        {"point": "50.3°, 30.3°", "durationMinutesOffsetFromStartTime": ""},
        {"point": "50.3°, 30.3°", "durationMinutesOffsetFromStartTime": "1.5"},
        {"point": "50.4°, 30.4°", "time": "2024-01-01T07:00:00Z"}, {"time": "2024-01-01T07:00:00Z"}]},
    {"startTime": "2024-01-01T06:00:00Z", "endTime": "2024-01-02T06:00:00Z", "timelineMemory": {"trip": {"distanceFromOriginKms": 12.5}}},
    {"startTime": "2024-01-01T06:00:00Z", "endTime": "2024-01-02T06:00:00Z", "timelineMemory": {"trip": {"distanceFromOriginKms": 0}}},
    {"startTime": 1704067200000, "endTime": "2024-01-01T00:01:00Z", "visit": {"topCandidate": {"placeLocation": "50.1, 30.1"}}},
    {"note": "nothing"},
]
PINGS = [
    {"latitudeE7": 501000000, "longitudeE7": 301000000, "timestamp": "2024-01-01T00:00:00.500Z"},
    {"latitudeE7": "501000000", "longitudeE7": 301000000, "timestamp": "2024-01-01T00:00:00Z"},
    {"latitudeE7": 910000000, "longitudeE7": 301000000, "timestamp": "2024-01-01T00:00:00Z"},
    {"latitudeE7": 501000000, "longitudeE7": 301000000, "timestampMs": "1704067200499"},
    {"latitudeE7": 501000000, "longitudeE7": 301000000, "timestamp": 7, "timestampMs": 1704067200500},
    {"latitudeE7": 501000000, "longitudeE7": 301000000},
]
T0 = 1704067200


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("exports")
    profile = {"frequentPlaces": [{"placeLocation": {"latLng": "50.1°, 30.1°"}, "label": " home "}, {"placeLocation": "x", "label": "WORK"},
                                  {"placeLocation": "51.0, 31.0", "label": ""}]}
    docs = {"line": {"userLocationProfile": profile, "semanticSegments": SEGMENTS, "rawSignals": [{"x": 1}]}, "ping": {"locations": PINGS},
            "other": {"foo": []}, "blank": {"locations": []}}
    for name, doc in docs.items():
        (path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    (path / "cut.json").write_text('{"locations": [{"latitudeE7": 5', encoding="utf-8")
    return str(path)


def test_whole_files(spark, folder):
    docs = exports.read_export_files(spark, folder)
    assert {r.subject_id: r.format for r in exports.detect_format(docs).collect()} == {
        "line": "semanticSegments", "ping": "locations", "other": None, "blank": "locations", "cut": None}
    assert {r.subject_id for r in exports.rejects(docs).collect()} == {"other", "cut"}
    pings = exports.ping_points(docs).orderBy("ord").collect()
    assert [r.ts_sec for r in pings] == [T0 + 1, T0, T0 + 1] and {r.lat for r in pings} == {50.1}
    visits = exports.segment_points(docs, "visit").orderBy("ord").collect()
    assert len(visits) == 865 + 1 + 2
    assert (visits[0].ts_sec, visits[1].ts_sec, visits[864].ts_sec) == (T0, T0 + 300, T0 + 3 * 86400)
    assert visits[865].ts_sec == T0 + 1 and visits[865].semantic_label is None and visits[0].semantic_label == "HOME"
    assert [r.ts_sec for r in visits[866:]] == [T0, T0 + 60]
    ends = exports.segment_points(docs, "activity").collect()
    assert [(r.ts_sec, r.source) for r in ends] == [(T0 + 3 * 3600, "movement")]
    ways = exports.segment_points(docs, "waypoint").orderBy("ord").collect()
    assert [r.ts_sec for r in ways] == [T0 + 6 * 3600 + 90, T0 + 7 * 3600]
    act = exports.activities(docs).collect()
    assert [(r.distance_m, r["mode"], r.raw_type) for r in act] == [(-5.0, "other", "cycling")]
    assert [r.distance_from_origin_km for r in exports.trips(docs).collect()] == [12.5]
    assert [(r.lat, r.label) for r in exports.frequent_places(docs).orderBy("ord").collect()] == [(50.1, "HOME"), (51.0, None)]
    report = {r.subject_id: (r.records_seen, r.records_skipped, r.points_found, r.status) for r in exports.ingest_report(docs).collect()}
    assert report == {"line": (8, 2, 871, "ok"), "ping": (6, 3, 3, "ok"), "other": (0, 0, 0, "unrecognized-format"),
                      "blank": (0, 0, 0, "no-points-found"), "cut": (0, 0, 0, "unrecognized-format")}
    assert exports.points(docs).count() == 874


def test_lines_and_stream_agree(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "points"
    landing.mkdir()
    batches = [{"subject_id": "a", "part": 0, "semanticSegments": SEGMENTS}, {"subject_id": "a", "part": 1, "locations": PINGS}]
    for i, doc in enumerate(batches):
        (landing / f"{i}.json").write_text(json.dumps(doc, ensure_ascii=False) + "\n", encoding="utf-8")
        append_points(spark, str(landing), str(out), str(tmp_path / "state")).awaitTermination()
    batch = exports.points(exports.read_export_lines(spark, str(landing)))
    streamed = spark.read.parquet(str(out)).select(batch.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect())) and batch.count() == 874


def test_point_tables(spark, make_points, tmp_path):
    pts = make_points([(T0 + i * 86400, 50, 30) for i in range(40)] + [(T0, 99, 30)])
    tables.write_points(tables.points_from_table(pts), str(tmp_path / "p"))
    back = tables.read_points(spark, str(tmp_path / "p"))
    assert back.count() == 40 and back.columns == list(tables.POINTS)
    pts.write.option("header", True).csv(str(tmp_path / "c"))
    assert tables.read_points(spark, str(tmp_path / "c"), "csv").count() == 40
    with pytest.raises(ValueError):
        tables.points_from_table(pts.drop("lat"))


def test_equal_file_names_are_different_people(spark, tmp_path):
    for name in ("alice", "bob"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Records.json").write_text(json.dumps({"locations": PINGS if name == "alice" else PINGS[:1]}), encoding="utf-8")
    for path in (f"{tmp_path}/*/Records.json", f"{tmp_path}/*/"):
        docs = exports.read_export_files(spark, path)
        assert {r.subject_id: r.format for r in exports.detect_format(docs).collect()} == {
            "alice/Records": "locations", "bob/Records": "locations"}
        report = {r.subject_id: r.records_seen for r in exports.ingest_report(docs).collect()}
        assert report == {"alice/Records": len(PINGS), "bob/Records": 1}


def test_long_visits_are_sampled_throughout(spark):
    element = {"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-31T00:00:00Z", "visit": {"topCandidate": {"placeLocation": "50.1, 30.1"}}}
    docs = spark.createDataFrame([("a", 0, json.dumps({"semanticSegments": [element]}))], "subject_id string, part bigint, doc string")
    pts = exports.points(exports.parse_documents(docs))
    assert pts.count() == 30 * 288 + 1 and pts.select("ord").distinct().count() == 30 * 288 + 1
    found = stays.stay_points(pts).collect()
    assert len(found) == 1 and found[0].end_sec - found[0].start_sec == 30 * 86400


def test_parts_out_of_range_fail_loudly(spark):
    docs = spark.createDataFrame([("a", 1 << 18, json.dumps({"locations": PINGS}))], "subject_id string, part bigint, doc string")
    with pytest.raises(Exception, match="out of range"):
        exports.points(exports.parse_documents(docs)).collect()
