"""The full profile per person and period."""

from pyspark.sql import functions as F

from sojourn.plans import profile
from workload import fixtures
from workload.fixtures import Inputs
from workload.registry import cte, query

_PARTS = ("SELECT 'all' AS key UNION ALL SELECT strftime(make_timestamp(p.{t} * 1000000), 'y%Y')"
          " UNION ALL SELECT strftime(make_timestamp(p.{t} * 1000000), 'y%Ym%m')")


def _by_period(text: str, time: str) -> str:
    """The same table with every row once per period; the person's key becomes person and period."""
    parts = _PARTS.format(t=time)
    return (f"SELECT p.* REPLACE (concat(p.subject_id, '|', k.key) AS subject_id) FROM ({fixtures.duckdb_text(text)}) p,"
            f" LATERAL ({parts}) k")


# A person of whom only activities are known.
_LONE = "SELECT * FROM ({0}) UNION ALL SELECT * REPLACE ('lone' AS subject_id) FROM ({0}) WHERE subject_id = 'u1'"
_BY_PERIOD = {"points": (_by_period(fixtures.POINTS, "ts_sec"), ()),
              "activities": (_by_period(_LONE.format(fixtures.ACTIVITIES), "start_sec"), ()),
              "trips": (_by_period(fixtures.TRIPS, "start_sec"), ())}
_KEYS = "split_part(subject_id, '|', 1) AS subject_id, split_part(subject_id, '|', 2) AS period_key"
cte("with_any", "SELECT subject_id FROM points UNION SELECT subject_id FROM activities UNION SELECT subject_id FROM trips", "points", "activities", "trips")


def _profile(t: Inputs) -> profile.Profile:
    lone = t.activities.filter("subject_id = 'u1'").withColumn("subject_id", F.lit("lone"))
    return profile.run_all(t.points, t.activities.unionByName(lone), t.trips, t.frequent_places)


@query("run_all", """SELECT split_part(w.subject_id, '|', 1) AS subject_id, split_part(w.subject_id, '|', 2) AS period_key,
      coalesce(s.point_count, 0) AS point_count, round(coalesce(s.span_days, 0), 6) AS span_days, round(coalesce(t.km, 0), 6) AS total_km, f.day AS farthest_day, round(f.km, 6) AS farthest_day_km,
      round(l.km, 6) AS longest_journey_km, coalesce(p.n, 0) AS place_count, round(c.coverage_ratio, 6) AS coverage_ratio, b.busiest_hour
    FROM with_any w LEFT JOIN spans s USING (subject_id)
    LEFT JOIN (SELECT subject_id, sum(km) AS km FROM mode_km GROUP BY 1) t ON t.subject_id = w.subject_id
    LEFT JOIN far_day f ON f.subject_id = w.subject_id LEFT JOIN longest l ON l.subject_id = w.subject_id
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM places GROUP BY 1) p ON p.subject_id = w.subject_id
    LEFT JOIN cover c ON c.subject_id = w.subject_id LEFT JOIN busy b ON b.subject_id = w.subject_id""",
       "with_any", "spans", "mode_km", "far_day", "longest", "places", "cover", "busy", override=_BY_PERIOD)
def _(t: Inputs):
    out = _profile(t).summary()
    rounded = [F.round(c, 6).alias(c) for c in ("span_days", "total_km", "farthest_day_km", "longest_journey_km", "coverage_ratio")]
    return out.select("subject_id", "period_key", "point_count", *rounded, "farthest_day", "place_count", "busiest_hour")


@query("profile_hours", f"SELECT {_KEYS}, hour, cnt FROM hours", "hours", override=_BY_PERIOD)
def _(t: Inputs):
    return _profile(t).hours


@query("profile_weekdays", f"SELECT {_KEYS}, weekday, cnt FROM weekdays", "weekdays", override=_BY_PERIOD)
def _(t: Inputs):
    return _profile(t).weekdays


@query("profile_modes", f"SELECT {_KEYS}, mode, round(km, 6) AS km, labelled FROM mode_km", "mode_km", override=_BY_PERIOD)
def _(t: Inputs):
    return _profile(t).mode_km.withColumn("km", F.round("km", 6))


@query("profile_journeys", f"SELECT {_KEYS}, start_sec, end_sec, duration_sec, round(km, 6) AS km FROM journeys", "journeys", override=_BY_PERIOD)
def _(t: Inputs):
    return _profile(t).journeys.drop("journey_no").withColumn("km", F.round("km", 6))
