"""Queries keep every row that their rule asks for."""

import __spark_entry__ as entry_point
from sojourn.operators import selection
from sojourn.sources import exports

SF = "/root/testdata/sf0.01"


def test_significant_places_have_no_bar_but_their_own(spark):
    queries = entry_point.queries()
    significant = {(r.subject_id, r.cluster_id) for r in queries["significant_places"](spark, SF).collect()}
    enough = queries["place_build"](spark, SF).filter("total_duration_sec >= 900")
    assert significant == {(r.subject_id, r.cluster_id) for r in enough.collect()}


def test_both_rules_of_significance(spark):
    places = spark.createDataFrame([("a", 0, 899), ("a", 1, 900), ("b", 0, 300), ("b", 1, 899)],
                                   "subject_id string, cluster_id int, total_duration_sec bigint")
    kept = sorted((r.subject_id, r.cluster_id) for r in selection.significant_places(places).collect())
    assert kept == [("a", 1), ("b", 0), ("b", 1)]


def test_points_are_made_from_their_number_alone(spark):
    where, lost = '"latLng":"1.5°, 2.5°"', '"nowhere"'
    doc = ('{"semanticSegments":['
           '{"startTime":"1970-01-01T00:00:00Z","endTime":"1970-01-01T00:10:00Z","visit":{"topCandidate":{"placeLocation":{%s},"semanticType":" home "}},'
           '"activity":{"start":%s,"end":{%s}},"timelinePath":[{"point":%s,"time":"1970-01-01T00:01:00Z"},{"point":"3°, 4°","durationMinutesOffsetFromStartTime":"2"},'
           '{"point":"3°, 4°","durationMinutesOffsetFromStartTime":""},{"point":"5°, 6°","time":"1970-01-01T00:03:00Z"}]},'
           '{"endTime":"1970-01-01T00:10:00Z","visit":{"topCandidate":{"placeLocation":{%s}}},"activity":{"start":{%s},"end":{%s}}},{}]}') % (
               where, lost, where, lost, where, where, where)
    docs = exports.parse_documents(spark.createDataFrame([("a", 0, doc)], "subject_id string, part bigint, doc string"))
    slots = 1 << 21
    visits = [(i, 1.5, 2.5, 300 * i, "visit", "HOME") for i in range(3)]
    ends = [(slots + 1, 1.5, 2.5, 600, "movement", None), ((1 << 22) + slots + 1, 1.5, 2.5, 600, "movement", None)]
    waypoints = [(slots + 3, 3.0, 4.0, 120, "movement", None), (slots + 5, 5.0, 6.0, 180, "movement", None)]
    for variants, want in (((), visits + ends + waypoints), (("visit",), visits), (("activity",), ends), (("waypoint",), waypoints),
                           (("activity", "waypoint"), ends + waypoints)):
        found = exports.segment_points(docs, *variants).drop("subject_id").collect()
        assert sorted(map(tuple, found)) == sorted(want), variants
    report = exports.ingest_report(docs).collect()[0]
    assert (report.records_seen, report.records_skipped, report.points_found) == (3, 1, 7)
    # Samples are most of the rows: no array of points is made for them, which would be done outside generated code.
    plan = exports.segment_points(docs, "visit")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
