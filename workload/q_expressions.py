"""Scalar rules of ingest and naming over whole tables."""

from pyspark.sql import functions as F

from sojourn.constants import CATEGORY_LABEL, NON_VENUE_TOKENS, SEMANTIC_BADGE, TRAVEL_MODE
from sojourn.functions import geo, lookups, text
from workload.fixtures import Inputs
from workload.registry import cte, query


def values(mapping: dict[str, str], key: str, value: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())
    return f"SELECT * FROM (VALUES {rows}) v({key}, {value})"


cte("travel_mode", values(TRAVEL_MODE, "raw_type", "mode"))
cte("category_label", values(CATEGORY_LABEL, "type", "label"))
cte("semantic_badge", values(SEMANTIC_BADGE, "label", "badge"))
cte("non_venue", "SELECT unnest([" + ", ".join(f"'{t}'" for t in NON_VENUE_TOKENS) + "]) AS token")

# Coordinate texts of every shape: degrees, geo URI, too few numbers, out of range, negative, NULL.
_COORD = """CASE event_id % 7 WHEN 0 THEN concat(a, '°, ', b, '°') WHEN 1 THEN concat('geo:', a, ',', b)
  WHEN 2 THEN concat(a, '°') WHEN 3 THEN concat('95.5, ', b) WHEN 4 THEN concat('lat -', a, ' lng -', b, ' alt 12.5')
  WHEN 5 THEN concat(CAST(k AS STRING), ', ', b) END"""
cte("coord_text", f"SELECT event_id, {_COORD} AS txt FROM raw_text", "raw_text")
_NUM = "regexp_extract_all(txt, '-?[0-9]+(?:\\.[0-9]+)?')"
cte("coord_pair", f"SELECT event_id, TRY_CAST({_NUM}[1] AS DOUBLE) AS lat, TRY_CAST({_NUM}[2] AS DOUBLE) AS lng FROM coord_text", "coord_text")


@query("parse_latlng", """SELECT event_id, CASE WHEN ok THEN round(lat, 6) END AS lat, CASE WHEN ok THEN round(lng, 6) END AS lng FROM
    (SELECT *, abs(lat) <= 90 AND abs(lng) <= 180 AS ok FROM coord_pair)""", "coord_pair")
def _(t: Inputs):
    at = text.parse_latlng(F.expr(_COORD))
    return t.raw_text.select("event_id", at.alias("at")).select("event_id", F.round("at.lat", 6).alias("lat"),
                                                                F.round("at.lng", 6).alias("lng"))


_WRAPPED = """CASE event_id % 3 WHEN 0 THEN concat('{"accuracy": 7, "latLng": "', a, '°, ', b, '°"}') WHEN 1 THEN concat(a, '°, ', b, '°')
  ELSE '{"latLng": "unknown"}' END"""


@query("read_location", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN round(lat_e7 / 1E7, 6) END AS lat,
    CASE WHEN event_id % 3 < 2 THEN round(lng_e7 / 1E7, 6) END AS lng FROM raw""", "raw")
def _(t: Inputs):
    at = text.read_location(F.expr(_WRAPPED))
    return t.raw_text.select("event_id", at.alias("at")).select("event_id", F.round("at.lat", 6).alias("lat"),
                                                                F.round("at.lng", 6).alias("lng"))


_STRETCHED = ("lat * (1 + ord % 3)", "lng * (1 + ord % 7)")


@query("valid_coordinate", f"""SELECT subject_id, ord, round(la, 6) AS lat, round(ln, 6) AS lng FROM
    (SELECT *, {_STRETCHED[0]} AS la, {_STRETCHED[1]} AS ln FROM points) WHERE abs(la) <= 90 AND abs(ln) <= 180""", "points")
def _(t: Inputs):
    moved = t.points.select("subject_id", "ord", F.expr(_STRETCHED[0]).alias("lat"), F.expr(_STRETCHED[1]).alias("lng"))
    return moved.filter(geo.valid_coordinate("lat", "lng")).select("subject_id", "ord", F.round("lat", 6).alias("lat"),
                                                                   F.round("lng", 6).alias("lng"))


_STAMP = """CASE event_id % 6 WHEN 0 THEN concat(iso, '.499Z') WHEN 1 THEN concat(iso, '.500Z') WHEN 2 THEN concat(iso, '+02:00')
  WHEN 3 THEN CAST(ms AS STRING) WHEN 4 THEN 'yesterday' END"""


@query("to_seconds", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts_sec WHEN 1 THEN ts_sec + 1 WHEN 2 THEN ts_sec - 7200
    WHEN 3 THEN CAST(floor(ms / 1000E0 + 0.5) AS BIGINT) END AS sec FROM raw""", "raw")
def _(t: Inputs):
    from sojourn.functions.calendar import utc_time

    iso = F.date_format(utc_time("ts_sec"), "yyyy-MM-dd'T'HH:mm:ss")
    return t.raw.withColumn("iso", iso).select("event_id", text.to_seconds(F.expr(_STAMP)).alias("sec"))


_LABEL = """CASE event_id % 6 WHEN 0 THEN ' home ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '  ' WHEN 3 THEN 'Inferred_Work' WHEN 4 THEN 'SEARCHED_ADDRESS' END"""
_LABEL_SQL = """CASE event_id % 6 WHEN 0 THEN 'HOME' WHEN 3 THEN 'INFERRED_WORK' WHEN 4 THEN 'SEARCHED_ADDRESS' END"""


@query("normalise_label", f"SELECT event_id, {_LABEL_SQL} AS label FROM raw", "raw")
def _(t: Inputs):
    return t.raw.select("event_id", text.normalise_label(F.expr(_LABEL)).alias("label"))


@query("semantic_badge", f"""SELECT r.event_id, b.badge FROM (SELECT event_id, {_LABEL_SQL} AS label FROM raw) r
    LEFT JOIN semantic_badge b ON b.label = r.label""", "raw", "semantic_badge")
def _(t: Inputs):
    return t.raw.select("event_id", lookups.semantic_badge(text.normalise_label(F.expr(_LABEL))).alias("badge"))


@query("travel_mode", """SELECT a.subject_id, a.start_sec, a.raw_type, coalesce(m.mode, 'other') AS mode FROM activities a
    LEFT JOIN travel_mode m ON m.raw_type = upper(a.raw_type)""", "activities", "travel_mode")
def _(t: Inputs):
    return t.activities.select("subject_id", "start_sec", "raw_type", lookups.travel_mode(F.lower("raw_type")).alias("mode"))


@query("haversine", """SELECT subject_id, ord, round(2 * 6371000E0 * asin(sqrt(pow(sin(radians(50.45E0 - lat) / 2), 2)
      + cos(radians(lat)) * cos(radians(50.45E0)) * pow(sin(radians(30.52E0 - lng) / 2), 2))), 4) AS meters FROM points""", "points")
def _(t: Inputs):
    there = t.points.withColumns({"to_lat": F.lit(50.45), "to_lng": F.lit(30.52)})
    return there.select("subject_id", "ord", F.round(geo.haversine_m("lat", "lng", "to_lat", "to_lng"), 4).alias("meters"))


@query("coord_key", """SELECT subject_id, cluster_id, CAST(floor(lat * 1E4 + 0.5) AS BIGINT) AS lat_key, CAST(floor(lng * 1E4 + 0.5) AS BIGINT) AS lng_key
    FROM targets""", "targets")
def _(t: Inputs):
    from sojourn.operators.enrichment import with_coord_key

    return with_coord_key(t.targets).select("subject_id", "cluster_id", "lat_key", "lng_key")


_CATEGORY = """CASE k % 7 WHEN 0 THEN 'Café & Bar' WHEN 1 THEN 'Gym / Fitness Center' WHEN 2 THEN ' -- ' WHEN 3 THEN 'Ünïversité'
  WHEN 4 THEN 'coffee_shop' WHEN 5 THEN concat('Piñata #', CAST(k AS STRING)) END"""


@query("category_token", f"""SELECT event_id, nullif(trim(regexp_replace(lower(strip_accents({_CATEGORY})), '[^a-z0-9]+', '_', 'g'), '_'), '') AS token
    FROM raw""", "raw")
def _(t: Inputs):
    return t.raw.select("event_id", text.category_token(F.expr(_CATEGORY)).alias("token"))


_TYPE = """CASE k % 9 WHEN 0 THEN 'cafe' WHEN 1 THEN 'garden' WHEN 2 THEN 'park' WHEN 3 THEN 'mall' WHEN 4 THEN 'department_store'
  WHEN 5 THEN 'tertiary' WHEN 6 THEN 'house' WHEN 7 THEN '' END"""


@query("category_label", f"""SELECT r.event_id, l.label FROM (SELECT event_id, {_TYPE} AS type FROM raw) r
    LEFT JOIN category_label l ON l.type = r.type""", "raw", "category_label")
def _(t: Inputs):
    return t.raw.select("event_id", lookups.category_label(F.expr(_TYPE)).alias("label"))


# One address record per event; each field is present in some of them only.
_FIELDS = {
    "city_district": "CASE WHEN k % 2 = 0 THEN concat('District ', CAST(k AS STRING)) END",
    "borough": "CASE WHEN k % 3 = 0 THEN 'Borough' END",
    "suburb": "CASE WHEN k % 5 = 0 THEN 'Suburb' END",
    "neighbourhood": "CASE WHEN k % 7 = 0 THEN ' Near ' END",
    "quarter": "CASE WHEN k % 11 = 0 THEN 'Quarter' END",
    "name": "CASE WHEN k % 4 = 0 THEN 'Oak House' WHEN k % 4 = 1 THEN '' END",
    "road": "CASE WHEN k % 3 = 1 THEN 'Elm St' WHEN k % 3 = 2 THEN '' END",
    "house_number": "CASE WHEN k % 5 < 2 THEN CAST(k AS STRING) END",
    "display_name": "CASE WHEN k % 7 < 5 THEN 'Mill Pond, Northside' WHEN k % 7 = 5 THEN ', x' END",
}
cte("records", "SELECT event_id, " + ", ".join(f"{sql} AS {n}" for n, sql in _FIELDS.items()) + " FROM raw", "raw")


def _records(t: Inputs):
    return t.raw.select("event_id", *[F.expr(sql).alias(n) for n, sql in _FIELDS.items()])


@query("district_pick", """SELECT event_id, coalesce(city_district, borough, suburb, neighbourhood, quarter) AS district FROM records""", "records")
def _(t: Inputs):
    return _records(t).select("event_id", text.district_pick("city_district", "borough", "suburb", "neighbourhood", "quarter").alias("district"))


@query("venue_district", "SELECT event_id, nullif(trim(CASE WHEN neighbourhood IS NULL THEN display_name ELSE neighbourhood END), '') AS district FROM records", "records")
def _(t: Inputs):
    return _records(t).select("event_id", text.venue_district(F.coalesce("neighbourhood", "display_name")).alias("district"))


@query("resolved_name", """SELECT event_id, coalesce(nullif(name, ''), nullif(trim(concat_ws(' ', nullif(road, ''), nullif(house_number, ''))), ''),
    nullif(split_part(display_name, ',', 1), ''), 'unknown place') AS name FROM records""", "records")
def _(t: Inputs):
    return _records(t).select("event_id", text.resolved_name("name", "road", "house_number", "display_name").alias("name"))


@query("display_name", "SELECT r.event_id, coalesce(r.name, printf('%.3f, %.3f', w.lat_e7 / 1E7 + 0.00021, w.lng_e7 / 1E7 + 0.00021)) AS display_name FROM records r JOIN raw w ON w.event_id = r.event_id",
       "records", "raw")
def _(t: Inputs):
    named = t.raw.select("event_id", F.expr(_FIELDS["name"]).alias("name"), F.expr("lat_e7 / 1E7 + 0.00021D").alias("lat"),
                         F.expr("lng_e7 / 1E7 + 0.00021D").alias("lng"))
    return named.select("event_id", text.display_name("name", "lat", "lng").alias("display_name"))
