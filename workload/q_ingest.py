"""Export documents built from the given events, read back through the sources.

One document holds the elements of one person among 4096 consecutive events, so its size is bounded at any scale.
"""

import uuid

from pyspark.sql import functions as F

from sojourn.functions.calendar import utc_time
from sojourn.operators.staging import ensure_checkpoint_dir
from sojourn.sources import exports, tables
from workload.fixtures import Inputs
from workload.registry import cte, query

_PART = 4096

# Raw pings: out of range, quoted number, epoch text, no time, bare-number time, ISO time.
_PING = """concat('{"latitudeE7":', CASE event_id % 10 WHEN 0 THEN '910000000' WHEN 1 THEN concat('"', lat_e7, '"') ELSE CAST(lat_e7 AS STRING) END,
  ',"longitudeE7":', lng_e7,
  CASE event_id % 10 WHEN 2 THEN concat(',"timestampMs":"', ms, '"') WHEN 3 THEN ''
    WHEN 4 THEN concat(',"timestamp":', ts_sec, ',"timestampMs":"', ms, '"') ELSE concat(',"timestamp":"', iso, 'Z"') END, '}')"""

# Timeline elements, by event_id % 8 (and a three-day visit now and then).
_SEGMENT = """CASE WHEN event_id % 64 = 6 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso3d, 'Z","visit":{"topCandidate":{"placeLocation":"geo:', a, ',', b, '"}}}')
  WHEN event_id % 8 = 0 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","visit":{"topCandidate":{"placeLocation":{"latLng":"', a, '°, ', b, '°"},"semanticType":"Inferred_Work"}}}')
  WHEN event_id % 8 = 1 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","visit":{"topCandidate":{"placeLocation":"', a, '°, ', b, '°","semanticType":"UNKNOWN"}}}')
  WHEN event_id % 8 = 2 THEN concat('{"startTime":"', iso, 'Z","visit":{"topCandidate":{"placeLocation":"', a, '°, ', b, '°","semanticType":" home "}}}')
  WHEN event_id % 8 = 3 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","activity":{"start":{"latLng":"', a, '°, ', b, '°"},"end":"',
       CASE WHEN k % 4 = 0 THEN '99.0°, 0.0°' ELSE concat(b, '°, ', a, '°') END, '"', CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"distanceMeters":', (k - 10) * 100) END,
       CASE WHEN k % 3 = 0 THEN '' ELSE concat(',"topCandidate":{"type":"', CASE WHEN k % 3 = 1 THEN 'IN_BUS' ELSE 'Hiking' END, '"}') END, '}}')
  WHEN event_id % 8 = 4 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","timelinePath":[{"point":"', a, '°, ', b, '°","time":"', iso_k,
       'Z"},{"point":"', b, '°, ', a, '°","durationMinutesOffsetFromStartTime":"', k, '"},{"point":"', a, '°, ', b, '°","durationMinutesOffsetFromStartTime":""},{"time":"', iso, 'Z"}]}')
  WHEN event_id % 8 = 5 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","timelineMemory":{"trip":{"distanceFromOriginKms":', CASE WHEN k < 20 THEN 0 ELSE k END, '}}}')
  WHEN event_id % 8 = 6 THEN concat('{"startTime":"', iso, 'Z","endTime":"', iso_k, 'Z","visit":{"topCandidate":{"placeLocation":"', a, '°, ', b, '°"}},"activity":{"start":"', b, '°, ', a,
       '°","end":"', a, '°, ', b, '°","distanceMeters":1500,"topCandidate":{"type":"WALKING"}}}')
  ELSE '{}' END"""

_PROFILE = ('"userLocationProfile":{"frequentPlaces":[{"placeLocation":{"latLng":"50.4000°, 30.5000°"},"label":" home "},'
            '{"placeLocation":"50.4243°, 30.5302°","label":"WORK"},{"placeLocation":"50.4360°, 30.5450°","label":"  "},'
            '{"placeLocation":"nowhere","label":"WORK"},{"placeLocation":"51.0°, 31.0°"}]}')


def _stamp(seconds):
    return F.date_format(utc_time(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def _documents(t: Inputs, element: str, key: str, prefix: str, tail: str = ""):
    rows = t.raw_text.withColumns({
        "iso": F.concat(_stamp("ts_sec"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")),
        "iso_k": _stamp(F.col("ts_sec") + (F.col("k") + 1) * 120), "iso3d": _stamp(F.col("ts_sec") + 3 * 86400)})
    rows = rows.select(F.concat(F.lit(prefix), "s").alias("subject_id"), F.floor(F.col("event_id") / _PART).alias("part"),
                       "event_id", F.expr(element).alias("element"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "element"))), lambda e: e["element"])
    body = F.concat(F.lit('{"' + key + '":['), F.array_join(ordered, ","), F.lit("]"))
    ending = F.when(F.col("part") == 0, F.lit("," + tail + "}")).otherwise(F.lit("}")) if tail else F.lit("}")
    return rows.groupBy("subject_id", "part").agg(body.alias("body")).select(
        "subject_id", "part", F.concat("body", ending).alias("doc"))


def _pings(t: Inputs):
    return _documents(t, _PING, "locations", "p")


def _timeline(t: Inputs):
    return _documents(t, _SEGMENT, "semanticSegments", "t", _PROFILE)


def _everything(t: Inputs):
    other = _pings(t).select(F.concat(F.lit("x"), "subject_id").alias("subject_id"), "part", F.lit('{"rawSignals":[]}').alias("doc"))
    empty = _pings(t).select(F.concat(F.lit("e"), "subject_id").alias("subject_id"), "part", F.lit('{"locations":[{}]}').alias("doc"))
    return exports.parse_documents(_pings(t).unionByName(_timeline(t)).unionByName(other).unionByName(empty))


_TS_ROUND = "CAST(floor(floor(ms) / 1000E0 + 0.5) AS BIGINT)"
_ORD = "(part * 8388608 + i) * 4194304"
cte("doc", f"""SELECT *, {_TS_ROUND} AS t0, ts_sec + (k + 1) * 120 AS t1, CAST(floor(event_id / {_PART}) AS BIGINT) AS part,
      row_number() OVER (PARTITION BY s, CAST(floor(event_id / {_PART}) AS BIGINT) ORDER BY event_id) - 1 AS i,
      lat_e7 / 1E7 AS la, lng_e7 / 1E7 AS ln FROM raw""", "raw")
cte("ping_rows", f"""SELECT concat('p', s) AS subject_id, {_ORD} AS ord, la AS lat, ln AS lng, t0 AS ts_sec, 'movement' AS source, CAST(NULL AS VARCHAR) AS semantic_label
    FROM doc WHERE event_id % 10 NOT IN (0, 1, 3)""", "doc")
cte("visit_span", """SELECT *, CASE WHEN event_id % 64 = 6 THEN ts_sec + 259200 WHEN event_id % 8 = 2 THEN NULL ELSE t1 END AS t_end,
      CASE WHEN event_id % 64 = 6 THEN NULL WHEN event_id % 8 = 0 THEN 'INFERRED_WORK' WHEN event_id % 8 = 2 THEN 'HOME' END AS lab
    FROM doc WHERE event_id % 8 IN (0, 1, 2, 6)""", "doc")
cte("visit_steps", """SELECT *, CASE WHEN t_end > t0 THEN CAST(greatest(floor((t_end - t0) / 300E0 + 0.5), 1) AS BIGINT) ELSE 0 END AS steps
    FROM visit_span""", "visit_span")
cte("visit_rows", f"""SELECT concat('t', s) AS subject_id, {_ORD} + n AS ord, la AS lat, ln AS lng,
      CASE WHEN steps > 0 THEN CAST(floor(t0 + (t_end - t0) * n / CAST(steps AS DOUBLE) + 0.5) AS BIGINT) ELSE t0 END AS ts_sec,
      'visit' AS source, lab AS semantic_label FROM visit_steps, LATERAL (SELECT unnest(range(steps + 1)) AS n) u""", "visit_steps")
cte("act_rows", f"""SELECT concat('t', s) AS subject_id, {_ORD} + n AS ord, CASE WHEN (n = 2097152) = (event_id % 8 = 3) THEN la ELSE ln END AS lat,
      CASE WHEN (n = 2097152) = (event_id % 8 = 3) THEN ln ELSE la END AS lng, CASE WHEN n = 2097152 THEN t0 ELSE t1 END AS ts_sec, 'movement' AS source,
      CAST(NULL AS VARCHAR) AS semantic_label
    FROM doc, LATERAL (SELECT unnest([2097152, 2097153]) AS n) u
    WHERE (event_id % 8 = 3 AND (n = 2097152 OR k % 4 <> 0)) OR (event_id % 8 = 6 AND event_id % 64 <> 6)""", "doc")
cte("way_rows", f"""SELECT concat('t', s) AS subject_id, {_ORD} + 2097154 + n AS ord, CASE WHEN n = 0 THEN la ELSE ln END AS lat, CASE WHEN n = 0 THEN ln ELSE la END AS lng,
      CASE WHEN n = 0 THEN t1 ELSE t0 + k * 60 END AS ts_sec, 'movement' AS source, CAST(NULL AS VARCHAR) AS semantic_label
    FROM doc, LATERAL (SELECT unnest([0, 1]) AS n) u WHERE event_id % 8 = 4""", "doc")
cte("act_table", """SELECT concat('t', s) AS subject_id, t0 AS start_sec, t1 AS end_sec,
      CASE WHEN event_id % 8 = 6 THEN 1500E0 ELSE (k - 10) * 100E0 END AS distance_m,
      CASE WHEN event_id % 8 = 6 THEN 'walk' WHEN k % 3 = 0 THEN 'other' WHEN k % 3 = 1 THEN 'transit' ELSE 'walk' END AS mode,
      CASE WHEN event_id % 8 = 6 THEN 'WALKING' WHEN k % 3 = 0 THEN 'UNKNOWN' WHEN k % 3 = 1 THEN 'IN_BUS' ELSE 'Hiking' END AS raw_type
    FROM doc WHERE (event_id % 8 = 3 AND k % 5 <> 0) OR (event_id % 8 = 6 AND event_id % 64 <> 6)""", "doc")

_POINT = "subject_id, ord, round(lat, 7) AS lat, round(lng, 7) AS lng, ts_sec, source, semantic_label"


def _shown(df):
    return df.select("subject_id", "ord", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), "ts_sec", "source", "semantic_label")


@query("ingest_records", f"SELECT {_POINT} FROM ping_rows", "ping_rows")
def _(t: Inputs):
    return _shown(exports.ping_points(exports.parse_documents(_pings(t))))


@query("ingest_visits", f"SELECT {_POINT} FROM visit_rows", "visit_rows")
def _(t: Inputs):
    return _shown(exports.segment_points(exports.parse_documents(_timeline(t)), "visit"))


@query("ingest_activity_points", f"SELECT {_POINT} FROM act_rows", "act_rows")
def _(t: Inputs):
    return _shown(exports.segment_points(exports.parse_documents(_timeline(t)), "activity"))


@query("ingest_waypoints", f"SELECT {_POINT} FROM way_rows", "way_rows")
def _(t: Inputs):
    return _shown(exports.segment_points(exports.parse_documents(_timeline(t)), "waypoint"))


@query("ingest_activities", "SELECT * FROM act_table", "act_table")
def _(t: Inputs):
    return exports.activities(exports.parse_documents(_timeline(t)))


@query("ingest_trips", """SELECT concat('t', s) AS subject_id, t0 AS start_sec, t1 AS end_sec, CAST(k AS DOUBLE) AS distance_from_origin_km
    FROM doc WHERE event_id % 8 = 5 AND k >= 20""", "doc")
def _(t: Inputs):
    return exports.trips(exports.parse_documents(_timeline(t)))


@query("ingest_frequent_places", """SELECT s.subject_id, v.ord, v.lat, v.lng, v.label FROM (SELECT DISTINCT concat('t', s) AS subject_id FROM doc WHERE part = 0) s
    CROSS JOIN (VALUES (0, 50.4E0, 30.5E0, 'HOME'), (1, 50.4243E0, 30.5302E0, 'WORK'), (2, 50.436E0, 30.545E0, NULL), (4, 51E0, 31E0, NULL)) v(ord, lat, lng, label)""", "doc")
def _(t: Inputs):
    return exports.frequent_places(exports.parse_documents(_timeline(t)))


cte("files", """SELECT DISTINCT concat(p.prefix, d.s) AS subject_id, d.part, p.prefix, p.format
    FROM (SELECT DISTINCT s, part FROM doc) d CROSS JOIN (VALUES ('p', 'locations'), ('t', 'semanticSegments'), ('xp', NULL), ('ep', 'locations')) p(prefix, format)""", "doc")


@query("detect_format", "SELECT subject_id, concat(subject_id, '/', part) AS file_id, format FROM files", "files")
def _(t: Inputs):
    return exports.detect_format(_everything(t))


cte("yield", """SELECT concat('p', s) AS subject_id, part, CASE WHEN event_id % 10 IN (0, 1, 3) THEN 0 ELSE 1 END AS n, event_id % 10 NOT IN (0, 1, 3) AS useful FROM doc
    UNION ALL SELECT concat('ep', s), part, 0, false FROM (SELECT DISTINCT s, part FROM doc)
    UNION ALL SELECT concat('t', d.s), d.part, coalesce(c.n, 0), coalesce(c.n, 0) > 0 OR (d.event_id % 8 = 5 AND d.k >= 20) FROM doc d
      LEFT JOIN (SELECT subject_id, CAST(floor(ord / 4194304) AS BIGINT) AS e, count(*) AS n FROM
        (SELECT subject_id, ord FROM visit_rows UNION ALL SELECT subject_id, ord FROM act_rows UNION ALL SELECT subject_id, ord FROM way_rows) GROUP BY ALL) c
      ON c.subject_id = concat('t', d.s) AND c.e = d.part * 8388608 + d.i""", "doc", "visit_rows", "act_rows", "way_rows")


@query("ingest_report", """SELECT f.subject_id, concat(f.subject_id, '/', f.part) AS file_id, f.format, coalesce(y.seen, 0) AS records_seen,
      coalesce(y.skipped, 0) AS records_skipped, coalesce(y.found, 0) AS points_found,
      CASE WHEN f.format IS NULL THEN 'unrecognized-format' WHEN coalesce(y.found, 0) = 0 THEN 'no-points-found' ELSE 'ok' END AS status
    FROM files f LEFT JOIN (SELECT subject_id, part, count(*) AS seen, count(*) FILTER (NOT useful) AS skipped, CAST(sum(n) AS BIGINT) AS found
                            FROM yield GROUP BY ALL) y ON y.subject_id = f.subject_id AND y.part = f.part""", "files", "yield")
def _(t: Inputs):
    return exports.ingest_report(_everything(t))


@query("normalise_variant", f"""SELECT {_POINT} FROM (SELECT * FROM ping_rows UNION ALL SELECT * FROM visit_rows UNION ALL SELECT * FROM act_rows
    UNION ALL SELECT * FROM way_rows)""", "ping_rows", "visit_rows", "act_rows", "way_rows")
def _(t: Inputs):
    # Through files: documents land as JSON lines in the shared folder and are read back by the JSON source.
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/landing-{uuid.uuid4().hex}"
    lines = _pings(t).unionByName(_timeline(t)).select(
        F.concat(F.lit('{"subject_id":"'), "subject_id", F.lit('","part":'), "part", F.lit(","), F.substring("doc", 2, 2147483646)).alias("value"))
    lines.write.text(folder)
    return _shown(exports.points(exports.read_export_lines(t.spark, folder)))


@query("points_from_table", """SELECT subject_id, ord, round(lat, 6) AS lat, round(lng, 6) AS lng, ts_sec, source, semantic_label FROM
    (SELECT * REPLACE (lat + 20 * (ord % 3) AS lat) FROM points) WHERE abs(lat) <= 90""", "points")
def _(t: Inputs):
    given = t.points.withColumn("lat", F.expr("lat + 20 * (ord % 3)"))
    return tables.points_from_table(given).select(
        "subject_id", "ord", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "ts_sec", "source", "semantic_label")
