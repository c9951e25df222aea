"""Location exports (raw pings or timeline segments, JSON) to point, activity, trip and frequent-place tables.

All readers give one row per document: ``subject_id, file_id, part`` and the parsed top-level keys. ``part`` numbers
the pieces of a history that arrives as several documents. Everything after that is the same for batch and stream.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.constants import VISIT_SAMPLE_SEC
from sojourn.functions import geo, lookups, text

PING = "struct<latitudeE7: double, longitudeE7: double, timestamp: string, timestampMs: string>"
# STRING where an export may hold either text or an object: Spark then keeps the object as JSON text.
SEGMENT = (
    "struct<startTime: string, endTime: string,"
    " visit: struct<topCandidate: struct<placeLocation: string, semanticType: string>>,"
    " activity: struct<start: string, end: string, distanceMeters: double, topCandidate: struct<type: string>>,"
    " timelinePath: array<struct<point: string, time: string, durationMinutesOffsetFromStartTime: string>>,"
    " timelineMemory: struct<trip: struct<distanceFromOriginKms: double>>>")
PROFILE = "struct<frequentPlaces: array<struct<placeLocation: string, label: string>>>"
DOCUMENT = f"locations array<{PING}>, semanticSegments array<{SEGMENT}>, userLocationProfile {PROFILE}"

# ``ord`` is (part, element, k) in one number: 18, 23 and 22 bits. k orders what one element yields: visit samples, activity
# start, activity end, waypoints. A number that does not fit its bits is an error, never a collision.
_PER_ELEMENT = 1 << 22
_VISIT_SLOTS = 1 << 21
_ACTIVITY_START = _VISIT_SLOTS
_ACTIVITY_END = _VISIT_SLOTS + 1
_WAYPOINTS = _VISIT_SLOTS + 2
ELEMENTS_PER_PART = 1 << 23
PARTS = 1 << 18


# --- readers ----------------------------------------------------------------------------

def read_export_files(spark: SparkSession, path: str) -> DataFrame:
    """One whole JSON document per file, as exported. Every file is one history, whatever its name.

    ``file_id`` is the file's full path. The subject is its path below the folder that ``path`` names (up to the first
    wildcard), without the extension: exports of all people carry the same file name, so they lie in folders of their own.
    A document cannot be split, so one file is one task. Large fleets should land documents as JSON lines.
    """
    docs = (spark.read.schema(f"{DOCUMENT}, _corrupt_record string").option("multiLine", True)
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    fixed = re.split(r"[*?\[{]", re.sub(r"^[a-z0-9+.-]+://[^/]*|^file:", "", path))[0]
    folder = fixed[:fixed.rfind("/") + 1] if fixed.endswith(".json") or fixed != path else fixed.rstrip("/") + "/"
    file_id = F.col("_metadata.file_path")
    below = F.regexp_replace(F.url_decode(F.regexp_replace(file_id, r"\+", "%2B")), "^.*?" + re.escape(re.sub("/+", "/", folder)), "")
    return docs.select(F.regexp_replace(below, r"\.json$", "").alias("subject_id"), file_id.alias("file_id"),
                       F.lit(0).cast("bigint").alias("part"), "locations", "semanticSegments",
                       "userLocationProfile", "_corrupt_record")


LINES = f"subject_id string, part bigint, {DOCUMENT}, _corrupt_record string"


def from_lines(lines: DataFrame) -> DataFrame:
    return lines.select("subject_id", F.concat_ws("/", "subject_id", "part").alias("file_id"), "part",
                        "locations", "semanticSegments", "userLocationProfile", "_corrupt_record")


def read_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one document per line with ``subject_id`` and ``part`` in it; splittable at any size."""
    return from_lines(spark.read.schema(LINES).json(path))


def parse_documents(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Documents that already are text in a table (``subject_id, part, doc``)."""
    parsed = docs.select("subject_id", F.col("part").cast("bigint").alias("part"),
                         F.from_json(F.col(column), f"{DOCUMENT}, _corrupt_record string",
                                     {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    return from_lines(parsed.select("subject_id", "part", "d.*"))


# --- format -----------------------------------------------------------------------------

def _format() -> Column:
    return (F.when(F.col("locations").isNotNull(), F.lit("locations"))
            .when(F.col("semanticSegments").isNotNull(), F.lit("semanticSegments")))


def detect_format(exports: DataFrame) -> DataFrame:
    """Format per file by content; NULL means that the file is no location export."""
    return exports.select("subject_id", "file_id", _format().alias("format"))


def rejects(exports: DataFrame) -> DataFrame:
    """Files without a known format, with their text when they did not parse."""
    return exports.filter(_format().isNull()).select("subject_id", "file_id", "_corrupt_record")


# --- elements ---------------------------------------------------------------------------

def _elements(exports: DataFrame, form: str) -> DataFrame:
    position = F.when((F.col("i") < ELEMENTS_PER_PART) & F.col("part").between(0, PARTS - 1),
                      F.col("part") * F.lit(ELEMENTS_PER_PART) + F.col("i"))
    position = F.coalesce(position, F.raise_error(F.lit("a document has too many elements, or a part is out of range")).cast("bigint"))
    return (exports.filter(_format() == form).select("subject_id", "file_id", "part", F.posexplode(form).alias("i", "e"))
            .select("subject_id", "file_id", position.alias("position"), "e"))


def pings(exports: DataFrame) -> DataFrame:
    """Elements of raw-ping exports with their coordinate and time (NULL where unusable)."""
    e = _elements(exports, "locations").select("subject_id", "file_id", "position", "e.*")
    lat, lng = F.col("latitudeE7") / 1e7, F.col("longitudeE7") / 1e7
    # A bare number under ``timestamp`` is not text in the export, so it is ignored.
    stamp = F.when(~F.col("timestamp").rlike(r"^-?\d+$"), F.col("timestamp"))
    seconds = F.when(stamp.isNotNull(), text.iso_seconds(stamp)).otherwise(text.millis_seconds("timestampMs"))
    return e.select("subject_id", "file_id", "position", lat.alias("lat"), lng.alias("lng"), seconds.alias("ts_sec"),
                    (geo.valid_coordinate(lat, lng) & seconds.isNotNull()).alias("usable"))


def segments(exports: DataFrame) -> DataFrame:
    """Elements of timeline exports with their times and coordinates parsed once; ``waypoints`` are the usable ones."""
    e = _elements(exports, "semanticSegments")
    start = text.to_seconds("e.startTime")

    def waypoint(step: Column, i: Column) -> Column:
        """At its own time, else at the segment's start plus a minute offset (blank is unknown, not 0)."""
        offset = text.blank_to_null(step["durationMinutesOffsetFromStartTime"]).try_cast("double")
        when = F.coalesce(text.to_seconds(step["time"]), text.js_round(start + offset * 60))
        return F.struct(i.alias("i"), when.alias("ts_sec"), text.parse_latlng(step["point"]).alias("at"))

    waypoints = F.filter(F.transform("e.timelinePath", waypoint), lambda w: w["at"].isNotNull() & w["ts_sec"].isNotNull())
    return e.select(
        "subject_id", "file_id", "position",
        start.alias("start_sec"), text.to_seconds("e.endTime").alias("end_sec"),
        text.read_location("e.visit.topCandidate.placeLocation").alias("visit_at"),
        text.normalise_label("e.visit.topCandidate.semanticType").alias("visit_label"),
        text.read_location("e.activity.start").alias("act_from"), text.read_location("e.activity.end").alias("act_to"),
        F.col("e.activity.distanceMeters").alias("act_m"), F.col("e.activity.topCandidate.type").alias("act_type"),
        waypoints.alias("waypoints"),
        F.col("e.timelineMemory.trip.distanceFromOriginKms").alias("trip_km"))


def _steps() -> Column:
    """Number of steps between the evenly spaced presence samples of a visit's span; 0 without a span."""
    span = F.col("end_sec") - F.col("start_sec")
    steps = F.when(span > 0, F.greatest(text.js_round(span / F.lit(float(VISIT_SAMPLE_SEC))), F.lit(1))).otherwise(F.lit(0)).cast("bigint")
    return F.when(steps < _VISIT_SLOTS, steps).otherwise(F.raise_error(F.lit("a visit is longer than its samples can be numbered")).cast("bigint"))


_VARIANTS = ("visit", "activity", "waypoint")


def _counted(elements: DataFrame) -> DataFrame:
    """``elements`` with the number of points that each yields by variant (both ends of a visit are samples)."""
    start, end = F.col("start_sec"), F.col("end_sec")
    visits = F.when(F.col("visit_at").isNotNull() & start.isNotNull(), F.col("steps") + 1)
    from_, to = F.col("act_from").isNotNull() & start.isNotNull(), F.col("act_to").isNotNull() & end.isNotNull()
    zero = F.lit(0).cast("bigint")
    return elements.withColumn("steps", _steps()).withColumns({
        "n_visit": F.coalesce(visits, zero), "n_from": from_.cast("bigint"), "n_activity": from_.cast("bigint") + to.cast("bigint"),
        "n_waypoint": F.greatest(F.coalesce(F.size("waypoints").cast("bigint"), zero), zero)})


def ping_points(exports: DataFrame) -> DataFrame:
    """Points of raw-ping exports."""
    return pings(exports).filter("usable").select(
        "subject_id", (F.col("position") * _PER_ELEMENT).alias("ord"), "lat", "lng", "ts_sec",
        F.lit("movement").alias("source"), F.lit(None).cast("string").alias("semantic_label"))


def segment_points(exports: DataFrame, *variants: str) -> DataFrame:
    """Points of timeline exports; ``variants`` among visit, activity and waypoint (all by default).

    An element is dealt to as many numbers as it yields points, and every point is made from its number alone. Nearly all rows are
    samples of long visits; they are plain arithmetic in generated code and never lie in arrays of points.
    """
    e = _counted(segments(exports))
    wanted = variants or _VARIANTS
    visits, ends, others = (F.col(f"n_{v}") if v in wanted else F.lit(0).cast("bigint") for v in _VARIANTS)
    e = e.withColumn("i", F.explode(F.when(visits + ends + others > 0, F.sequence(F.lit(0).cast("bigint"), visits + ends + others - 1))))

    i, start = F.col("i"), F.col("start_sec")
    of_visit, of_activity = i < visits, i < visits + ends
    sampled = F.when(F.col("steps") > 0, text.js_round(start + (F.col("end_sec") - start) * i / F.greatest("steps", F.lit(1)))).otherwise(start)
    first = i - visits < F.col("n_from")
    way = F.get("waypoints", (i - visits - ends).cast("int"))

    def of(visit: Column, activity: Column, waypoint: Column) -> Column:
        value = F.when(of_visit, visit).when(of_activity, activity)
        return value.otherwise(waypoint) if "waypoint" in wanted else value

    def coordinate(c: str) -> Column:
        return of(F.col("visit_at")[c], F.when(first, F.col("act_from")[c]).otherwise(F.col("act_to")[c]), way["at"][c])

    k = of(i, F.when(first, F.lit(_ACTIVITY_START)).otherwise(F.lit(_ACTIVITY_END)), way["i"] + F.lit(_WAYPOINTS))
    return e.select(
        "subject_id", (F.col("position") * _PER_ELEMENT + k).alias("ord"), coordinate("lat").alias("lat"), coordinate("lng").alias("lng"),
        of(sampled, F.when(first, start).otherwise(F.col("end_sec")), way["ts_sec"]).alias("ts_sec"),
        F.when(of_visit, F.lit("visit")).otherwise(F.lit("movement")).alias("source"), F.when(of_visit, F.col("visit_label")).alias("semantic_label"))


def points(exports: DataFrame) -> DataFrame:
    """All points of both formats, in the shared point schema."""
    return ping_points(exports).unionByName(segment_points(exports))


def _has_activity() -> Column:
    m = F.col("act_m")
    finite = m.isNotNull() & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf")))
    return finite & F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()


def _has_trip() -> Column:
    return F.coalesce((F.col("trip_km") > 0) & (F.col("trip_km") < F.lit(float("inf"))), F.lit(False)) & F.col(
        "start_sec").isNotNull() & F.col("end_sec").isNotNull()


def activities(exports: DataFrame) -> DataFrame:
    """Stated activities: a finite distance (negative ones included) and both times are needed."""
    raw_type = F.coalesce("act_type", F.lit("UNKNOWN"))
    return segments(exports).filter(_has_activity()).select(
        "subject_id", "start_sec", "end_sec", F.col("act_m").alias("distance_m"),
        lookups.travel_mode(raw_type).alias("mode"), raw_type.alias("raw_type"))


def trips(exports: DataFrame) -> DataFrame:
    """Remembered trips with a positive distance from the origin."""
    return segments(exports).filter(_has_trip()).select(
        "subject_id", "start_sec", "end_sec", F.col("trip_km").alias("distance_from_origin_km"))


def frequent_places(exports: DataFrame) -> DataFrame:
    """Places of the profile of timeline exports; blank labels become NULL, bad coordinates are dropped."""
    rows = exports.filter(_format() == "semanticSegments").select(
        "subject_id", "part", F.posexplode("userLocationProfile.frequentPlaces").alias("i", "f"))
    return (rows.withColumn("at", text.read_location("f.placeLocation")).filter(F.col("at").isNotNull())
            .select("subject_id", (F.col("part") * F.lit(ELEMENTS_PER_PART) + F.col("i")).alias("ord"),
                    F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"),
                    text.blank_to_null(F.upper(text.trimmed("f.label"))).alias("label")))


def ingest_report(exports: DataFrame) -> DataFrame:
    """Per file: format, records seen, records that yielded nothing, points found, and a status."""
    from_pings = pings(exports).select("file_id", F.col("usable").cast("bigint").alias("n"), F.col("usable").alias("useful"))
    n = F.col("n_visit") + F.col("n_activity") + F.col("n_waypoint")
    from_segments = _counted(segments(exports)).select("file_id", n.alias("n"), ((n > 0) | _has_activity() | _has_trip()).alias("useful"))
    counts = (from_pings.unionByName(from_segments).groupBy("file_id")
              .agg(F.count(F.lit(1)).alias("records_seen"), F.count_if(~F.col("useful")).alias("records_skipped"),
                   F.sum("n").alias("points_found")))
    zero = F.lit(0).cast("bigint")
    out = detect_format(exports).join(counts, "file_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("records_seen", "records_skipped", "points_found")})
    status = (F.when(F.col("format").isNull(), F.lit("unrecognized-format"))
              .when(F.col("points_found") == 0, F.lit("no-points-found")).otherwise(F.lit("ok")))
    return out.withColumn("status", status)
