"""Stay detection: where somebody remained within 100 m of a first point for ten minutes or more.

The anchor scan is sequential, so the track is first cut where the scan is *certain* to restart:

* after a silence longer than the allowed inner gap;
* after a step longer than twice the radius (both ends of a run lie within one radius of its anchor);
* between two time blocks of half the minimum stay that both spread over more than twice the radius. A stay
  that covered the cut would last at least two blocks and so contain one of them whole.

The pieces (islands) are independent. Islands shorter than the minimum stay are dropped, islands that fit within one
radius are a single stay and become a plain aggregation (so a phone that never moves is split over all tasks), and
only the rest goes through a streaming Arrow kernel whose memory does not grow with the island. Islands of many points are
scanned piece by piece by many tasks at once (``operators/stretches.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import STAY_MAX_GAP_SEC, STAY_MIN_SEC, STAY_RADIUS_M
from sojourn.functions import geo
from sojourn.operators.anchor import anchor_scan
from sojourn.operators.ordered import CHUNK, Keys, scan, with_time_chunk
from sojourn.operators.selection import SUBJECT
from sojourn.operators.staging import staged, staged_table
from sojourn.operators.stretches import PIECE_ROWS, STAY, speculative_stays

# Guards against last-digit differences between the cut test and the scan.
_SLACK_M = 0.01


def islands(points: DataFrame, keys: Keys = SUBJECT, radius_m: float = STAY_RADIUS_M, min_sec: int = STAY_MIN_SEC,
            max_gap_sec: int = STAY_MAX_GAP_SEC, chunk_sec: int | None = None) -> DataFrame:
    """Points with their position in the key's track and the number of their island (both in time order)."""
    half = min_sec // 2
    base = with_time_chunk(points, keys, chunk_sec).select(
        *keys, CHUNK, "ord", "ts_sec", "lat", "lng", "semantic_label",
        F.floor(F.col("ts_sec") / half).cast("bigint").alias("block"))
    # Placed by (key, chunk) at once and ordered although the frame is the whole block, so that one shuffle and one
    # sort serve this window and the scan's.
    base = base.repartition(*keys, CHUNK)
    block = (Window.partitionBy(*keys, CHUNK, "block").orderBy("ts_sec", "ord")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spread = geo.box_extent_m(F.min("lat").over(block), F.max("lat").over(block),
                              F.min("lng").over(block), F.max("lng").over(block))
    base = base.withColumn("wide", (spread > 2 * radius_m + _SLACK_M).cast("int"))

    step = geo.haversine_sql("prev_lat", "prev_lng", "lat", "lng")
    cut = (f"ts_sec - prev_ts_sec > {max_gap_sec} OR {step} > {2 * radius_m + _SLACK_M}D"
           f" OR (wide = 1 AND prev_wide = 1 AND floor(ts_sec / {half}) = floor(prev_ts_sec / {half}) + 1)")
    cut_rows = scan(base, keys, ("ts_sec", "lat", "lng", "wide"), {"island": cut, "pos": "true"},
                    order=("block", "ts_sec", "ord"),
                    counted=("semantic_label",))
    label = F.when(F.col("n_semantic_label") > 0, F.col("semantic_label")).alias("semantic_label")
    return cut_rows.select(*keys, CHUNK, "island", "pos", "ts_sec", "lat", "lng", label)


def _label_of_islands(rows: DataFrame, keys: Keys) -> DataFrame:
    """Most frequent label per island; the one seen first wins ties."""
    counted = (rows.filter(F.coalesce(F.col("semantic_label") != "", F.lit(False)))
               .groupBy(*keys, "island", "semantic_label")
               .agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first")))
    rank = F.struct(F.col("c"), -F.col("first"))
    return counted.groupBy(*keys, "island").agg(F.max_by("semantic_label", rank).alias("semantic_label"))


def stay_points(points: DataFrame, keys: Keys = SUBJECT, radius_m: float = STAY_RADIUS_M, min_sec: int = STAY_MIN_SEC,
                max_gap_sec: int = STAY_MAX_GAP_SEC, chunk_sec: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Stays per key: ``sid`` (0-based, by start), span, centroid, number of points, label."""
    rows = staged_table(islands(points, keys, radius_m, min_sec, max_gap_sec, chunk_sec))
    return numbered(stays_of_islands(rows, keys, radius_m, min_sec, piece_rows), keys)


def numbered(stays: DataFrame, keys: Keys) -> DataFrame:
    # Stays are disjoint and at least min_sec long: a key has at most (its span / min_sec) of them.
    by_start = Window.partitionBy(*keys).orderBy("start_sec")
    return stays.withColumn("sid", (F.row_number().over(by_start) - 1).cast("bigint"))


def stays_of_islands(rows: DataFrame, keys: Keys, radius_m: float = STAY_RADIUS_M, min_sec: int = STAY_MIN_SEC,
                     piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Stays of rows with their ``island``, ``pos`` and chunk, a written table; the positions of an island are consecutive."""
    per_island = rows.groupBy(*keys, "island").agg(
        F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"),
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("point_count"),
        geo.box_diagonal_m(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")).alias("_reach"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
    ).filter(F.col("end_sec") - F.col("start_sec") >= min_sec)
    per_island = staged(per_island)
    compact = F.col("_reach") <= radius_m - _SLACK_M
    long = F.col("point_count") > 2 * piece_rows
    stay = [f.split()[0] for f in STAY.split(", ")]

    whole = (per_island.filter(compact).join(_label_of_islands(rows, keys), [*keys, "island"], "left").select(*keys, *stay))

    # Rows of the remaining islands: selected per (island, chunk), so that a huge compact island is never gathered.
    chunks = rows.select(*keys, "island", CHUNK).distinct()

    def of(some: DataFrame) -> DataFrame:
        pieces = chunks.join(some.select(*keys, "island", "first_pos", "last_pos"), [*keys, "island"])
        return rows.join(pieces, [*keys, "island", CHUNK]).select(
            *keys, "island", "pos", "ts_sec", "lat", "lng", "semantic_label", "first_pos", "last_pos")

    rest = of(per_island.filter(~compact & ~long)).drop("first_pos", "last_pos")
    rest = rest.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "pos")
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]
    key_fields.sort(key=lambda s: list(keys).index(s.split()[0]))
    walked = rest.mapInArrow(anchor_scan(list(keys), radius_m, min_sec), ", ".join([*key_fields, STAY]))

    stays = whole.unionByName(walked)
    many = per_island.filter(~compact & long)
    if not many.isEmpty():
        stays = stays.unionByName(speculative_stays(of(many), keys, radius_m, min_sec, piece_rows))
    return stays
