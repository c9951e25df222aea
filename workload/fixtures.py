"""Input tables derived from the given ``events`` table by SQL; one text serves Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Whole UTC epoch seconds of the zone-less events.ts, independent of any session time zone.
TS_SEC = {
    "spark": "(CAST(date_diff(CAST(ts AS DATE), DATE '1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600"
             " + minute(ts) * 60 + second(ts))",
    "duckdb": "CAST(floor(epoch_us(ts) / 1E6) AS BIGINT)",
}

POINTS = """
SELECT concat('u', CAST(s AS STRING)) AS subject_id, event_id AS ord,
       50.40E0 + 0.012E0 * spot + (k - 50) * 0.0000061803E0
         + CASE WHEN blk % 17 = 0 THEN 0.003E0 * (blk % 41) ELSE 0E0 END AS lat,
       30.50E0 + 0.015E0 * spot + (value - 100E0) * 0.0000020331E0 AS lng,
       ts_sec,
       CASE WHEN event_type IN ('click', 'error') THEN 'movement' ELSE 'visit' END AS source,
       CASE WHEN event_type IN ('click', 'error') THEN NULL
            WHEN spot = 0 THEN 'HOME'
            WHEN spot = 1 AND event_id % 3 = 0 THEN 'INFERRED_WORK' END AS semantic_label
FROM (SELECT *, CAST((blk + s) % 5 AS INT) AS spot
      FROM (SELECT *, CAST(floor(ts_sec / 10800E0) AS BIGINT) AS blk
            FROM (SELECT event_id, event_type, value, CAST(user_id % 10 AS INT) AS s,
                         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, {TS_SEC} AS ts_sec
                  FROM {events}) e) f) g
"""

ACTIVITIES = """
SELECT subject_id, start_sec, end_sec, distance_m,
       CASE WHEN raw_type IN ('WALKING', 'RUNNING') THEN 'walk' WHEN raw_type IN ('IN_BUS', 'IN_SUBWAY', 'IN_TRAIN') THEN 'transit'
            WHEN raw_type = 'IN_PASSENGER_VEHICLE' THEN 'drive' ELSE 'other' END AS mode, raw_type
FROM (SELECT concat('u', CAST(s AS STRING)) AS subject_id, t AS start_sec, t + 600 + 30 * k AS end_sec,
             value * 40E0 AS distance_m,
             CASE k % 8 WHEN 0 THEN 'WALKING' WHEN 1 THEN 'IN_BUS' WHEN 2 THEN 'IN_SUBWAY' WHEN 3 THEN 'IN_PASSENGER_VEHICLE'
                        WHEN 4 THEN 'CYCLING' WHEN 5 THEN 'RUNNING' WHEN 6 THEN 'UNKNOWN' ELSE 'IN_TRAIN' END AS raw_type
      FROM (SELECT value, CAST(user_id % 10 AS INT) AS s, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, {TS_SEC} AS t
            FROM {events} WHERE event_type = 'click' AND user_id % 10 < 6) e) a
"""

TRIPS = """
SELECT concat('u', CAST(user_id % 10 AS STRING)) AS subject_id, {TS_SEC} AS start_sec,
       {TS_SEC} + 86400 AS end_sec, value AS distance_from_origin_km
FROM {events} WHERE event_type = 'error' AND value > 100 AND user_id % 10 < 3
"""

FREQUENT_PLACES = """
SELECT p.subject_id, v.ord, v.lat, v.lng, v.label
FROM (SELECT DISTINCT concat('u', CAST(user_id % 10 AS STRING)) AS subject_id FROM {events}) p
CROSS JOIN (SELECT 1 AS ord, 50.4000E0 AS lat, 30.5000E0 AS lng, 'HOME' AS label
  UNION ALL SELECT 2, 50.4243E0, 30.5302E0, 'WORK'
  UNION ALL SELECT 3, 50.4360E0, 30.5450E0, NULL
  UNION ALL SELECT 4, 51.0000E0, 31.0000E0, 'WORK') v
"""

# Every customer is a place of the person of its nation; two customers share a site. Suppliers are venues near sites.
_SITE_LAT = "(-60E0 + 0.002E0 * ({0} * 37 % 60000))"
_SITE_LNG = "(30.50E0 + 0.015E0 * ({0} % 11))"
_SITE = "CAST(floor(c_custkey / 2E0) AS BIGINT)"

TARGETS = f"""
SELECT concat('u', CAST(c_nationkey AS STRING)) AS subject_id, CAST(c_custkey AS INT) AS cluster_id,
       {_SITE_LAT.format(_SITE)} + 0.000013E0 * (c_custkey % 2) AS lat, {_SITE_LNG.format(_SITE)} + 0.000013E0 * (c_custkey % 2) AS lng,
       CAST(1200 * (1 + c_custkey % 17) * (1 + c_custkey % 3) AS BIGINT) AS total_duration_sec
FROM {{customer}}
"""

ADDRESSES = """
SELECT lat_key, lng_key,
       CASE spot WHEN 0 THEN 'Oak House' WHEN 1 THEN '' WHEN 3 THEN 'Ring Road' END AS name,
       CASE spot WHEN 0 THEN 'Oak St' WHEN 1 THEN 'Elm St' WHEN 3 THEN 'Ring Rd' END AS road,
       CASE spot WHEN 0 THEN '1' WHEN 1 THEN '22' END AS house_number,
       CASE spot WHEN 2 THEN 'Mill Pond, Northside, Town' ELSE 'x, y' END AS display_name,
       CASE kind WHEN 0 THEN 'apartments' WHEN 1 THEN 'cafe' WHEN 2 THEN 'park' WHEN 3 THEN 'bank' WHEN 4 THEN 'school'
                 WHEN 5 THEN 'hospital' WHEN 6 THEN 'restaurant' WHEN 7 THEN 'supermarket' ELSE 'tertiary' END AS type,
       CASE spot WHEN 0 THEN concat('East ', CAST(kind AS STRING)) END AS city_district, CAST(NULL AS STRING) AS borough,
       CASE spot WHEN 1 THEN concat('Centre ', CAST(kind AS STRING)) WHEN 0 THEN 'ignored' END AS suburb, CAST(NULL AS STRING) AS neighbourhood,
       CASE spot WHEN 2 THEN 'Northside' END AS quarter
FROM (SELECT lat_key, lng_key, first % 5 AS spot, first % 9 AS kind
      FROM (SELECT CAST(floor(t.lat * 1E4 + 0.5E0) AS BIGINT) AS lat_key, CAST(floor(t.lng * 1E4 + 0.5E0) AS BIGINT) AS lng_key,
                   min(t.cluster_id) AS first FROM {targets} t GROUP BY 1, 2) k) x
WHERE spot < 4
"""

VENUES = f"""
SELECT CAST(s_suppkey AS INT) AS venue_id,
       CASE s_suppkey % 7 WHEN 0 THEN 'Corner Bank' WHEN 1 THEN 'Far Cafe' WHEN 2 THEN 'Centre' WHEN 3 THEN ' ' WHEN 4 THEN 'Gym'
                          WHEN 5 THEN 'Café Nine' ELSE s_name END AS name,
       {_SITE_LAT.format('s_suppkey')} + CASE s_suppkey % 7 WHEN 1 THEN 0.0006E0 WHEN 4 THEN 0.0013E0 ELSE 0.0002E0 END AS lat,
       {_SITE_LNG.format('s_suppkey')} + 0.0001E0 AS lng,
       CASE s_suppkey % 7 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Coffee Shop' WHEN 2 THEN 'Neighborhood,City' WHEN 3 THEN 'Park'
                          WHEN 4 THEN 'Gym / Fitness Center' WHEN 5 THEN 'Town,Café' ELSE 'Hotel' END AS categories,
       CASE s_suppkey % 7 WHEN 0 THEN ' Old Town ' WHEN 1 THEN 'Old Town' WHEN 4 THEN '' WHEN 5 THEN 'Riverside' END AS neighborhood
FROM {{supplier}}
UNION ALL
SELECT CAST(s_suppkey + 1000000000 AS INT), 'Next Door', {_SITE_LAT.format('s_suppkey')} + 0.0001E0, {_SITE_LNG.format('s_suppkey')}, 'Bakery', NULL
FROM {{supplier}} WHERE s_suppkey % 5 = 0
"""

# Fields that the text expressions and the export documents are built from.
RAW = """
SELECT event_id, s, concat('u', CAST(s AS STRING)) AS subject_id, k, value, ts_sec, ms,
       CAST(floor(lat * 1E7 + 0.5E0) AS BIGINT) AS lat_e7, CAST(floor(lng * 1E7 + 0.5E0) AS BIGINT) AS lng_e7
FROM (SELECT event_id, CAST(user_id % 10 AS INT) AS s, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, value,
             {TS_SEC} AS ts_sec, {TS_MS} AS ms,
             50.40E0 + 0.001E0 * (event_id % 97) AS lat, 30.50E0 + 0.001E0 * (event_id % 89) AS lng
      FROM {events}) e
"""
TS_MS = {
    "spark": TS_SEC["spark"] + " * 1000 + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT) % 1000",
    "duckdb": "CAST(floor(epoch_us(ts) / 1E3) AS BIGINT)",
}


def e7_text(column: str) -> str:
    """A positive E7 integer as decimal text, in SQL that both engines read alike."""
    return (f"concat(CAST(CAST(floor({column} / 1E7) AS BIGINT) AS STRING), '.',"
            f" lpad(CAST({column} % 10000000 AS STRING), 7, '0'))")


RAW_TEXT = f"""
SELECT *, {e7_text('lat_e7')} AS a, {e7_text('lng_e7')} AS b FROM {{raw}}
"""


class Inputs:
    """The derived tables as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        names = {n: "{" + n + "}" for n in frames}
        return self.spark.sql(text.format(TS_SEC=TS_SEC["spark"], TS_MS=TS_MS["spark"], **names), **frames)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def points(self) -> DataFrame:
        return self.sql(POINTS, events=self.events)

    @cached_property
    def activities(self) -> DataFrame:
        return self.sql(ACTIVITIES, events=self.events)

    @cached_property
    def trips(self) -> DataFrame:
        return self.sql(TRIPS, events=self.events)

    @cached_property
    def frequent_places(self) -> DataFrame:
        return self.sql(FREQUENT_PLACES, events=self.events)

    @cached_property
    def targets(self) -> DataFrame:
        return self.sql(TARGETS, customer=self.table("customer"))

    @cached_property
    def addresses(self) -> DataFrame:
        return self.sql(ADDRESSES, targets=self.targets)

    @cached_property
    def venues(self) -> DataFrame:
        return self.sql(VENUES, supplier=self.table("supplier"))

    @cached_property
    def raw(self) -> DataFrame:
        return self.sql(RAW, events=self.events)

    @cached_property
    def raw_text(self) -> DataFrame:
        return self.sql(RAW_TEXT, raw=self.raw)


def duckdb_text(text: str) -> str:
    return text.format(TS_SEC=TS_SEC["duckdb"], TS_MS=TS_MS["duckdb"], events="events", targets="targets", raw="raw",
                       customer="customer", supplier="supplier")
