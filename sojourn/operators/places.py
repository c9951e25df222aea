"""Recurring places: clusters of stays with rank, label and lifecycle.

Windows by key in this file run over places or stays of a key. Stays are disjoint and last ten minutes or more, so
their number is bounded by the key's time span, however many points it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import (
    FREQUENT_PLACE_MATCH_M,
    LIFECYCLE_MIN_VISITS,
    LIFECYCLE_WINDOW_MAX_SEC,
    LIFECYCLE_WINDOW_MIN_SEC,
    LIFECYCLE_WINDOW_SHARE,
)
from sojourn.functions import geo
from sojourn.operators.clustering import cell_of, cells_around, dbscan
from sojourn.operators.ordered import Keys
from sojourn.operators.selection import SUBJECT
from sojourn.operators.staging import staged


def clustered_stays(stays: DataFrame, keys: Keys = SUBJECT, **options) -> DataFrame:
    """Stays with their ``cluster_id``. The stays are staged once for the clustering and for the join back."""
    kept = staged(stays)
    return kept.join(dbscan(kept, keys=keys, items_staged=True, **options), [*keys, "sid"])


def label_mode(stays: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Most frequent label among a place's stays; the one seen first wins ties."""
    counted = (stays.filter((F.col("cluster_id") >= 0) & F.coalesce(F.col("semantic_label") != "", F.lit(False)))
               .groupBy(*keys, "cluster_id", "semantic_label")
               .agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("first")))
    best = F.max_by("semantic_label", F.struct(F.col("c"), -F.col("first")))
    return counted.groupBy(*keys, "cluster_id").agg(best.alias("semantic_label"))


def place_build(stays: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """One row per cluster; noise is left out. ``stays`` carries ``cluster_id``."""
    n = F.col("point_count")
    built = stays.filter("cluster_id >= 0").groupBy(*keys, "cluster_id").agg(
        (F.sum(F.col("lat") * n) / F.sum(n)).alias("lat"), (F.sum(F.col("lng") * n) / F.sum(n)).alias("lng"),
        F.sum(n).alias("point_count"), F.count(F.lit(1)).alias("visit_count"),
        F.sum(F.col("end_sec") - F.col("start_sec")).alias("total_duration_sec"),
        F.min("start_sec").alias("first_seen_sec"), F.max("end_sec").alias("last_seen_sec"),
        F.min("sid").alias("first_sid"))
    return built.join(label_mode(stays, keys), [*keys, "cluster_id"], "left")


def nearest_frequent_place(places: DataFrame, frequent: DataFrame, keys: Keys = SUBJECT,
                           within_m: float = FREQUENT_PLACE_MATCH_M) -> DataFrame:
    """Fills missing place labels from the nearest labelled frequent place (inclusive radius, first wins ties)."""
    row, col = cell_of("lat", "lng", within_m)
    stated = (frequent.filter(F.coalesce(F.col("label") != "", F.lit(False)))
              .select("subject_id", F.col("ord").alias("f_ord"), F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng"),
                      "label", row.alias("row"), col.alias("col")))
    open_places = places.filter(F.col("semantic_label").isNull() | (F.col("semantic_label") == "")).select(
        *keys, "cluster_id", "lat", "lng",
        F.explode(cells_around("lat", "lat", "lng", "lng", within_m, within_m)).alias("_c"))
    open_places = open_places.select(*keys, "cluster_id", "lat", "lng", "_c.row", "_c.col")
    meters = geo.haversine_m("lat", "lng", "f_lat", "f_lng")
    found = (open_places.join(stated, ["subject_id", "row", "col"]).withColumn("meters", meters)
             .filter(F.col("meters") <= within_m)
             .groupBy(*keys, "cluster_id").agg(F.min_by("label", F.struct("meters", "f_ord")).alias("_adopted")))
    return (places.join(found, [*keys, "cluster_id"], "left")
            .withColumn("semantic_label", F.coalesce(F.nullif("semantic_label", F.lit("")), "_adopted")).drop("_adopted"))


def place_lifecycle(places: DataFrame, spans: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Adds ``lifecycle``: abandoned, new or NULL. ``spans`` has first_sec and last_sec of the whole history."""
    window = F.least(
        F.greatest(F.greatest(F.col("last_sec") - F.col("first_sec"), F.lit(1)) * F.lit(LIFECYCLE_WINDOW_SHARE),
                   F.lit(float(LIFECYCLE_WINDOW_MIN_SEC))),
        F.lit(float(LIFECYCLE_WINDOW_MAX_SEC)))
    regular = F.col("visit_count") >= LIFECYCLE_MIN_VISITS
    stage = (F.when(regular & (F.col("last_seen_sec") < F.col("last_sec") - F.col("_w")), F.lit("abandoned"))
             .when(regular & (F.col("first_seen_sec") > F.col("first_sec") + F.col("_w")), F.lit("new")))
    return (places.join(spans.select(*keys, "first_sec", "last_sec"), list(keys))
            .withColumn("_w", window).withColumn("lifecycle", stage).drop("_w", "first_sec", "last_sec"))


def lifecycle_sorted(places: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return (places.filter(F.col("lifecycle").isNotNull())
            .orderBy(*keys, "lifecycle", F.desc("total_duration_sec"), "first_sid"))


def place_rank(places: DataFrame, keys: Keys = SUBJECT, tie: str = "first_sid") -> DataFrame:
    """Adds ``rank`` by time spent; ties keep the order of the first stay."""
    order = Window.partitionBy(*keys).orderBy(F.desc("total_duration_sec"), tie)
    return places.withColumn("rank", F.row_number().over(order))


def top_places(places: DataFrame, n: int, keys: Keys = SUBJECT, tie: str = "first_sid") -> DataFrame:
    return place_rank(places, keys, tie).filter(F.col("rank") <= n)


def share_of_top(df: DataFrame, value: str, keys: Keys = SUBJECT, name: str = "share_of_top") -> DataFrame:
    """A value relative to the key's largest one (never divided by less than 1)."""
    top = F.greatest(F.max(value).over(Window.partitionBy(*keys)), F.lit(1))
    return df.withColumn(name, F.col(value) / top)


def share_of_total(df: DataFrame, value: str, keys: Keys = SUBJECT, name: str = "share_of_total") -> DataFrame:
    """A value relative to the key's sum; 0 when the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0)))


def place_hours_per_day(places: DataFrame, spans: DataFrame, keys: Keys = SUBJECT, tie: str = "first_sid") -> DataFrame:
    """Hours per day of the history spent at each place, and its share of the leading place."""
    ranked = place_rank(places, keys, tie).join(spans.select(*keys, "span_days"), list(keys))
    leader = F.max(F.when(F.col("rank") == 1, F.col("total_duration_sec"))).over(Window.partitionBy(*keys))
    hours = F.when(F.col("span_days") > 0, F.col("total_duration_sec") / 3600 / F.col("span_days")).otherwise(F.lit(0.0))
    return ranked.select(*keys, "cluster_id", "rank", hours.alias("hours_per_day"),
                         (F.col("total_duration_sec") / F.when(leader == 0, 1).otherwise(leader)).alias("share_of_leader"))
