"""Registry of queries and the builder of their SQL twins from shared common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import fixtures
from workload.fixtures import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def hav(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    """Great-circle metres in SQL."""
    h = (f"(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat}))"
         f" * pow(sin(radians({b_lng} - {a_lng}) / 2), 2))")
    return f"(2 * 6371000E0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def cte(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (sql, needs)


def oracle(select: str, *needs: str, override: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """``select`` with every needed common table expression in front, in dependency order."""
    table = {**_CTES, **(override or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in table[name][1]:
            visit(need)
        ordered.append(name)

    for need in needs:
        visit(need)
    parts = ",\n".join(f"{n} AS ({table[n][0]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{select}" if parts else select


def query(name: str, select: str | None = None, *needs: str, override=None):
    """Registers ``build(inputs) -> DataFrame`` and, with ``select``, its SQL twin."""
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if select is not None:
            ORACLES[name] = oracle(select, *needs, override=override)
        return build
    return register


for _name, _text in (("points", fixtures.POINTS), ("activities", fixtures.ACTIVITIES), ("trips", fixtures.TRIPS),
                     ("frequent_places", fixtures.FREQUENT_PLACES), ("targets", fixtures.TARGETS),
                     ("venues", fixtures.VENUES), ("raw", fixtures.RAW)):
    cte(_name, fixtures.duckdb_text(_text))
cte("addresses", fixtures.duckdb_text(fixtures.ADDRESSES), "targets")
cte("raw_text", fixtures.duckdb_text(fixtures.RAW_TEXT), "raw")

# --- movement ---------------------------------------------------------------------------
cte("mv", """SELECT p.* FROM points p JOIN (SELECT subject_id, bool_or(source = 'movement') AS m FROM points GROUP BY 1) f
    ON f.subject_id = p.subject_id WHERE p.source = 'movement' OR NOT f.m""", "points")
cte("trk", f"""SELECT *, ts_sec - p_ts AS dt_sec, {hav('p_lat', 'p_lng', 'lat', 'lng')} / 1000 AS km0
    FROM (SELECT *, lag(ts_sec) OVER w AS p_ts, lag(lat) OVER w AS p_lat, lag(lng) OVER w AS p_lng FROM mv
          WINDOW w AS (PARTITION BY subject_id ORDER BY ts_sec, ord))""", "mv")
cte("trk2", """SELECT *, CASE WHEN dt_sec > 0 THEN km0 END AS km, CASE WHEN dt_sec > 0 THEN km0 / (dt_sec / 3600E0) END AS kmh
    FROM trk""", "trk")
cte("leg", """SELECT *, NOT kmh > 200 AS counted, CASE WHEN kmh <= 7 THEN 'walk' WHEN kmh <= 30 THEN 'transit' ELSE 'drive' END AS mode,
    strftime(make_timestamp(ts_sec * 1000000), '%Y-%m-%d') AS day FROM trk2 WHERE dt_sec > 0""", "trk2")
cte("jrow", """SELECT *, sum(brk) OVER (PARTITION BY subject_id ORDER BY ts_sec, ord ROWS UNBOUNDED PRECEDING) AS journey_no
    FROM (SELECT *, CASE WHEN dt_sec > 0 AND (dt_sec > 1500 OR kmh < 1.5) THEN 1 ELSE 0 END AS brk FROM trk2)""", "trk2")
cte("journeys", """SELECT subject_id, min(ts_sec) AS start_sec, max(ts_sec) AS end_sec, max(ts_sec) - min(ts_sec) AS duration_sec,
    sum(km) FILTER (kmh >= 1.5 AND kmh <= 200) AS km FROM jrow GROUP BY subject_id, journey_no
    HAVING sum(km) FILTER (kmh >= 1.5 AND kmh <= 200) > 0""", "jrow")
cte("mode_km", """SELECT s.subject_id, m.mode, coalesce(a.km, CASE WHEN l.subject_id IS NULL THEN h.km END, 0) AS km,
           l.subject_id IS NOT NULL AS labelled
    FROM (SELECT subject_id FROM points UNION SELECT subject_id FROM activities) s
    CROSS JOIN (SELECT unnest(['walk', 'transit', 'drive', 'other']) AS mode) m
    LEFT JOIN (SELECT DISTINCT subject_id FROM activities) l ON l.subject_id = s.subject_id
    LEFT JOIN (SELECT subject_id, mode, sum(distance_m) / 1000 AS km FROM activities GROUP BY ALL) a
           ON a.subject_id = s.subject_id AND a.mode = m.mode
    LEFT JOIN (SELECT subject_id, mode, sum(km) AS km FROM leg WHERE counted GROUP BY ALL) h
           ON h.subject_id = s.subject_id AND h.mode = m.mode""", "points", "activities", "leg")
cte("day_km", "SELECT subject_id, day, sum(km) AS km FROM leg WHERE counted GROUP BY ALL", "leg")
cte("far_day", """SELECT subject_id, day, km FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY km DESC, day) AS rn
    FROM day_km) WHERE rn = 1""", "day_km")
cte("longest", """SELECT subject_id, km, start_sec, end_sec, duration_sec, from_trip FROM (
      SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY km DESC, from_trip, start_sec) AS rn FROM (
        SELECT subject_id, km, start_sec, end_sec, duration_sec, false AS from_trip FROM journeys
        UNION ALL SELECT subject_id, distance_from_origin_km, start_sec, end_sec, end_sec - start_sec, true FROM trips))
    WHERE rn = 1""", "journeys", "trips")

# --- stays and places (sequential definitions, by recursion) -------------------------------
cte("o", """SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts_sec, ord) AS i,
    CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY subject_id ORDER BY ts_sec, ord) > 7200 THEN 1 ELSE 0 END AS gap FROM points""",
    "points")
cte("isl", "SELECT *, sum(gap) OVER (PARTITION BY subject_id ORDER BY i) AS isl FROM o", "o")
cte("lim", "SELECT *, max(i) OVER (PARTITION BY subject_id, isl) + 1 AS isl_end FROM isl", "isl")
cte("brk", f"""SELECT a.subject_id, a.i, any_value(a.ts_sec) AS t0,
           coalesce(min(b.i) FILTER (WHERE {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} > 100E0), any_value(a.isl_end)) AS j
    FROM lim a LEFT JOIN lim b ON a.subject_id = b.subject_id AND a.isl = b.isl AND b.i > a.i
    GROUP BY a.subject_id, a.i""", "lim")
cte("nxt", """SELECT k.*, l.ts_sec AS t1, l.ts_sec - k.t0 >= 600 AS is_stay,
           CASE WHEN l.ts_sec - k.t0 >= 600 THEN k.j ELSE k.i + 1 END AS n
    FROM brk k JOIN lim l ON l.subject_id = k.subject_id AND l.i = k.j - 1""", "brk", "lim")
cte("walk", """SELECT subject_id, i, n FROM nxt WHERE i = 1
    UNION ALL SELECT x.subject_id, x.i, x.n FROM walk w JOIN nxt x ON x.subject_id = w.subject_id AND x.i = w.n""", "nxt")
cte("spell", """SELECT x.subject_id, x.i, x.j, x.t0 AS start_sec, x.t1 AS end_sec
    FROM walk JOIN nxt x ON x.subject_id = walk.subject_id AND x.i = walk.i WHERE x.is_stay""", "walk", "nxt")
cte("spell_label", """SELECT subject_id, i, semantic_label FROM (
      SELECT s.subject_id, s.i, p.semantic_label, row_number() OVER (PARTITION BY s.subject_id, s.i ORDER BY count(*) DESC, min(p.i)) AS rn
      FROM spell s JOIN lim p ON p.subject_id = s.subject_id AND p.i >= s.i AND p.i < s.j
      WHERE p.semantic_label <> '' GROUP BY s.subject_id, s.i, p.semantic_label) WHERE rn = 1""", "spell", "lim")
cte("stays", """SELECT s.subject_id, row_number() OVER (PARTITION BY s.subject_id ORDER BY s.start_sec, s.i) - 1 AS sid, s.start_sec, s.end_sec,
           avg(p.lat) AS lat, avg(p.lng) AS lng, count(*) AS point_count, any_value(l.semantic_label) AS semantic_label
    FROM spell s JOIN lim p ON p.subject_id = s.subject_id AND p.i >= s.i AND p.i < s.j
    LEFT JOIN spell_label l ON l.subject_id = s.subject_id AND l.i = s.i
    GROUP BY s.subject_id, s.i, s.start_sec, s.end_sec""", "spell", "lim", "spell_label")
cte("nb", f"""SELECT a.subject_id, a.sid AS a, b.sid AS b, b.point_count AS w FROM stays a JOIN stays b
    ON a.subject_id = b.subject_id AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 120E0""", "stays")
cte("core", "SELECT subject_id, a AS sid FROM nb GROUP BY ALL HAVING count(*) >= 4", "nb")
cte("ce", """SELECT nb.* FROM nb JOIN core c ON c.subject_id = nb.subject_id AND c.sid = nb.a
    JOIN core d ON d.subject_id = nb.subject_id AND d.sid = nb.b""", "nb", "core")
cte("reach", """SELECT subject_id, sid AS root, sid AS node FROM core
    UNION SELECT r.subject_id, r.root, ce.b FROM reach r JOIN ce ON ce.subject_id = r.subject_id AND ce.a = r.node WHERE r.root < ce.b""",
    "core", "ce")
cte("comp", "SELECT subject_id, node AS sid, min(root) AS root FROM reach GROUP BY ALL", "reach")
cte("ids", "SELECT *, dense_rank() OVER (PARTITION BY subject_id ORDER BY root) - 1 AS cid FROM comp", "comp")
cte("labelled", """SELECT s.*, CAST(coalesce(own.cid, bord.cid, -1) AS INT) AS cluster_id
    FROM stays s LEFT JOIN ids own ON own.subject_id = s.subject_id AND own.sid = s.sid
    LEFT JOIN (SELECT nb.subject_id, nb.a AS sid, min(ids.cid) AS cid FROM nb
               JOIN ids ON ids.subject_id = nb.subject_id AND ids.sid = nb.b GROUP BY ALL) bord
      ON bord.subject_id = s.subject_id AND bord.sid = s.sid""", "stays", "ids", "nb")
cte("place_label", """SELECT subject_id, cluster_id, semantic_label FROM (
      SELECT subject_id, cluster_id, semantic_label, row_number() OVER (PARTITION BY subject_id, cluster_id
             ORDER BY count(*) DESC, min(sid)) AS rn
      FROM labelled WHERE cluster_id >= 0 AND semantic_label <> '' GROUP BY subject_id, cluster_id, semantic_label)
    WHERE rn = 1""", "labelled")
cte("places", """SELECT g.*, l.semantic_label FROM (
      SELECT subject_id, cluster_id, sum(lat * point_count) / sum(point_count) AS lat, sum(lng * point_count) / sum(point_count) AS lng,
             CAST(sum(point_count) AS BIGINT) AS point_count, count(*) AS visit_count,
             CAST(sum(end_sec - start_sec) AS BIGINT) AS total_duration_sec, min(start_sec) AS first_seen_sec,
             max(end_sec) AS last_seen_sec, min(sid) AS first_sid
      FROM labelled WHERE cluster_id >= 0 GROUP BY subject_id, cluster_id) g
    LEFT JOIN place_label l ON l.subject_id = g.subject_id AND l.cluster_id = g.cluster_id""", "labelled", "place_label")
cte("ranked", """SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY total_duration_sec DESC, first_sid) AS rank
    FROM places""", "places")
cte("spans", """SELECT subject_id, min(ts_sec) AS first_sec, max(ts_sec) AS last_sec, (max(ts_sec) - min(ts_sec)) / 86400E0 AS span_days,
    count(*) AS point_count FROM points GROUP BY 1""", "points")
cte("adopted", f"""SELECT p.* EXCLUDE (semantic_label), coalesce(p.semantic_label, m.label) AS semantic_label FROM places p
    LEFT JOIN (SELECT subject_id, cluster_id, label FROM (
        SELECT p.subject_id, p.cluster_id, f.label, row_number() OVER (PARTITION BY p.subject_id, p.cluster_id
               ORDER BY {hav('p.lat', 'p.lng', 'f.lat', 'f.lng')}, f.ord) AS rn
        FROM places p JOIN frequent_places f ON f.subject_id = p.subject_id AND f.label <> ''
         AND {hav('p.lat', 'p.lng', 'f.lat', 'f.lng')} <= 120E0) WHERE rn = 1) m
    ON m.subject_id = p.subject_id AND m.cluster_id = p.cluster_id""", "places", "frequent_places")
cte("staged_places", """SELECT p.*, CASE WHEN visit_count < 4 THEN NULL WHEN last_seen_sec < last_sec - w THEN 'abandoned'
           WHEN first_seen_sec > first_sec + w THEN 'new' END AS lifecycle
    FROM (SELECT p.*, s.first_sec, s.last_sec, least(greatest(greatest(s.last_sec - s.first_sec, 1) * 0.12E0, 1209600E0), 15552000E0) AS w
          FROM places p JOIN spans s ON s.subject_id = p.subject_id) p""", "places", "spans")
