"""Stays, clusters, places."""

from pyspark.sql import functions as F

from sojourn.operators import clustering, patterns, places, selection, stays
from sojourn.plans import profile
from workload import fixtures
from workload.fixtures import Inputs
from workload.registry import cte, query


def _stays(t: Inputs):
    return stays.stay_points(t.points)


def _clustered(t: Inputs):
    return places.clustered_stays(_stays(t))


def _places(t: Inputs):
    return places.place_build(_clustered(t))


def _r(*names):
    return [F.round(c, 6).alias(c) for c in names]


@query("stay_points", """SELECT subject_id, sid, start_sec, end_sec, round(lat, 6) AS lat, round(lng, 6) AS lng, point_count, semantic_label
    FROM stays""", "stays")
def _(t: Inputs):
    return _stays(t).select("subject_id", "sid", "start_sec", "end_sec", *_r("lat", "lng"), "point_count", "semantic_label")


@query("eps_neighbours", "SELECT subject_id, a AS sid, count(*) AS neighbours FROM nb GROUP BY ALL", "nb")
def _(t: Inputs):
    return clustering.eps_neighbour_weights(_stays(t)).select("subject_id", "sid", F.col("weight").cast("bigint").alias("neighbours"))


@query("dbscan", "SELECT subject_id, sid, cluster_id FROM labelled", "labelled")
def _(t: Inputs):
    return clustering.dbscan(_stays(t))


_HEAVY = 24


@query("dbscan_weighted", "SELECT subject_id, sid, cluster_id FROM labelled", "labelled",
       override={"core": (f"SELECT subject_id, a AS sid FROM nb GROUP BY ALL HAVING sum(w) >= {_HEAVY}", ("nb",))})
def _(t: Inputs):
    return clustering.dbscan(_stays(t), min_pts=_HEAVY, weight_col="point_count")


_PLACE = """subject_id, cluster_id, round(lat, 6) AS lat, round(lng, 6) AS lng, point_count, visit_count, total_duration_sec,
    first_seen_sec, last_seen_sec"""


@query("place_build", f"SELECT {_PLACE} FROM places", "places")
def _(t: Inputs):
    return _places(t).select("subject_id", "cluster_id", *_r("lat", "lng"), "point_count", "visit_count", "total_duration_sec",
                             "first_seen_sec", "last_seen_sec")


@query("label_mode", "SELECT subject_id, cluster_id, semantic_label FROM place_label", "place_label")
def _(t: Inputs):
    return places.label_mode(_clustered(t))


@query("nearest_frequent_place", "SELECT subject_id, cluster_id, semantic_label FROM adopted", "adopted")
def _(t: Inputs):
    return places.nearest_frequent_place(_places(t), t.frequent_places).select("subject_id", "cluster_id", "semantic_label")


# Some people move: after ten days one spot is given up for a new one, and until the twentieth day another lies elsewhere.
_MOVED = """CASE WHEN lng > 30.51E0 AND lng < 30.52E0 AND ts_sec >= 1704931200 THEN lng + 0.1E0
     WHEN lng > 30.525E0 AND lng < 30.535E0 AND ts_sec <= 1705795200 THEN lng + 0.2E0 ELSE lng END"""
_HISTORY = {"points": (f"SELECT * REPLACE ({_MOVED} AS lng) FROM ({fixtures.duckdb_text(fixtures.POINTS)})", ())}


def _lifecycle(t: Inputs):
    history = t.points.withColumn("lng", F.expr(_MOVED))
    built = places.place_build(places.clustered_stays(stays.stay_points(history)))
    return places.place_lifecycle(built, patterns.span_days(history))


@query("place_lifecycle", "SELECT subject_id, cluster_id, lifecycle FROM staged_places", "staged_places", override=_HISTORY)
def _(t: Inputs):
    return _lifecycle(t).select("subject_id", "cluster_id", "lifecycle")


@query("lifecycle_sorted", """SELECT subject_id, lifecycle, cluster_id, total_duration_sec FROM staged_places WHERE lifecycle IS NOT NULL
    ORDER BY subject_id, lifecycle, total_duration_sec DESC""", "staged_places", override=_HISTORY)
def _(t: Inputs):
    return places.lifecycle_sorted(_lifecycle(t)).select("subject_id", "lifecycle", "cluster_id", "total_duration_sec")


@query("place_rank", "SELECT subject_id, rank, cluster_id, round(lat, 6) AS lat, round(lng, 6) AS lng, visit_count, total_duration_sec FROM ranked", "ranked")
def _(t: Inputs):
    return places.place_rank(_places(t)).select("subject_id", "rank", "cluster_id", *_r("lat", "lng"), "visit_count", "total_duration_sec")


def _top(n: int, name: str):
    @query(name, f"SELECT subject_id, rank, cluster_id, total_duration_sec FROM ranked WHERE rank <= {n}", "ranked")
    def _(t: Inputs):
        return places.top_places(_places(t), n).select("subject_id", "rank", "cluster_id", "total_duration_sec")


_top(25, "top_geocode_targets")
_top(6, "top_places")
_top(8, "top_markers")

# A place at 15 minutes or more is significant.
cte("significant", """SELECT * EXCLUDE (m) FROM (SELECT *, bool_or(total_duration_sec >= 900) OVER (PARTITION BY subject_id) AS m FROM places)
    WHERE total_duration_sec >= 900 OR NOT m""", "places")


@query("significant_places", "SELECT subject_id, cluster_id, total_duration_sec FROM significant", "significant")
def _(t: Inputs):
    return selection.significant_places(_places(t)).select("subject_id", "cluster_id", "total_duration_sec")


@query("place_hours_per_day", """SELECT r.subject_id, r.cluster_id, r.rank,
      round(CASE WHEN span_days > 0 THEN total_duration_sec / 3600E0 / span_days ELSE 0 END, 6) AS hours_per_day,
      round(total_duration_sec / max(total_duration_sec) OVER (PARTITION BY r.subject_id), 6) AS share_of_leader
    FROM ranked r JOIN spans s ON s.subject_id = r.subject_id""", "ranked", "spans")
def _(t: Inputs):
    return places.place_hours_per_day(_places(t), patterns.span_days(t.points)).select(
        "subject_id", "cluster_id", "rank", *_r("hours_per_day", "share_of_leader"))


@query("headline", """SELECT s.subject_id, s.point_count, round(s.span_days, 6) AS span_days, coalesce(p.n, 0) AS place_count FROM spans s
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM (SELECT *, bool_or(total_duration_sec >= 900) OVER (PARTITION BY subject_id) AS m FROM places)
               WHERE total_duration_sec >= 900 OR NOT m GROUP BY 1) p ON p.subject_id = s.subject_id""", "spans", "places")
def _(t: Inputs):
    return profile.headline(t.points, _places(t)).withColumn("span_days", F.round("span_days", 6))
