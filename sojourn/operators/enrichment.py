"""Names, categories and districts for places, by joins to venue and address tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import TOP_BREAKDOWN, VENUE_RADIUS_M
from sojourn.functions import geo, lookups, text
from sojourn.operators.clustering import cell_of, cells_around
from sojourn.operators.ordered import Keys
from sojourn.operators.places import share_of_total
from sojourn.operators.selection import SUBJECT


def with_coord_key(df: DataFrame) -> DataFrame:
    """Adds the rounded coordinate (four decimals) as two integers; invalid coordinates are dropped."""
    return (df.filter(geo.valid_coordinate("lat", "lng"))
            .withColumns({"lat_key": geo.scaled_key("lat"), "lng_key": geo.scaled_key("lng")}))


def nearest_venue(targets: DataFrame, venues: DataFrame, radius_m: float = VENUE_RADIUS_M) -> DataFrame:
    """The nearest venue of each distinct rounded coordinate: ``(lat_key, lng_key, venue_id, meters)``.

    Targets are reduced to distinct keys first, so a cell holds a bounded number of them whatever the
    number of people, and ``min_by`` combines on the map side.
    """
    spots = with_coord_key(targets).select("lat_key", "lng_key").distinct().withColumns(
        {"lat": F.col("lat_key") / 1e4, "lng": F.col("lng_key") / 1e4})
    row, col = cell_of("lat", "lng", radius_m)
    there = venues.select("venue_id", F.col("lat").alias("v_lat"), F.col("lng").alias("v_lng"),
                          row.alias("row"), col.alias("col"))
    here = spots.withColumn("_c", F.explode(cells_around("lat", "lat", "lng", "lng", radius_m, radius_m)))
    here = here.select("lat_key", "lng_key", "lat", "lng", "_c.row", "_c.col")
    return (here.join(there, ["row", "col"]).withColumn("meters", geo.haversine_m("lat", "lng", "v_lat", "v_lng"))
            .filter(F.col("meters") <= radius_m)
            .groupBy("lat_key", "lng_key").agg(F.min(F.struct("meters", "venue_id")).alias("best"))
            .select("lat_key", "lng_key", "best.venue_id", "best.meters"))


def venue_filter(venues: DataFrame) -> DataFrame:
    """Venues worth naming: a name, and a category that is not only geography. Adds ``type`` and ``district``."""
    raw = F.split(F.coalesce("categories", F.lit("")), ",")
    tokens = F.filter(F.transform(raw, text.category_token), lambda t: t.isNotNull())
    useful = F.filter("_tokens", lambda t: ~F.array_contains(lookups.non_venue_tokens(), t))
    name = text.blank_to_null(text.trimmed("name"))
    # A venue that is given twice counts once: the row that sorts first.
    venues = venues.groupBy("venue_id").agg(F.min(F.struct("name", "categories", "neighborhood")).alias("_v")).select("venue_id", "_v.*")
    return (venues.withColumn("_tokens", tokens)
            .withColumn("type", F.try_element_at(useful, F.lit(1)))
            .filter(name.isNotNull() & ((F.size("_tokens") == 0) | F.col("type").isNotNull()))
            .select("venue_id", name.alias("name"), "type", text.venue_district("neighborhood").alias("district")))


def venue_names(targets: DataFrame, venues: DataFrame) -> DataFrame:
    """First tier: ``(lat_key, lng_key, name, type, district)`` from the nearest venue, when that one is useful."""
    return nearest_venue(targets, venues).join(venue_filter(venues), "venue_id").drop("venue_id", "meters")


def resolved_addresses(addresses: DataFrame) -> DataFrame:
    """One row for each coordinate key. Of several rows of a key the one that sorts first by all its columns counts."""
    rest = [c for c in addresses.columns if c not in ("lat_key", "lng_key")]
    once = addresses.groupBy("lat_key", "lng_key").agg(F.min(F.struct(*rest)).alias("_a")).select("lat_key", "lng_key", "_a.*")
    return once.select(
        "lat_key", "lng_key", text.resolved_name("name", "road", "house_number", "display_name").alias("name"),
        lookups.category_label("type").alias("category"),
        text.district_pick("city_district", "borough", "suburb", "neighbourhood", "quarter").alias("district"))


def address_lookup(targets: DataFrame, addresses: DataFrame) -> DataFrame:
    """Targets with the name, category and district of their rounded coordinate; targets without a row are absent."""
    return with_coord_key(targets).join(resolved_addresses(addresses), ["lat_key", "lng_key"])


def two_tier_names(targets: DataFrame, venues: DataFrame, addresses: DataFrame) -> DataFrame:
    """Venue first, address second; a venue without a district takes the address's."""
    v = venue_names(targets, venues).select("lat_key", "lng_key", F.col("name").alias("v_name"),
                                            lookups.category_label("type").alias("v_category"),
                                            F.col("district").alias("v_district"))
    a = resolved_addresses(addresses).withColumnsRenamed(
        {"name": "a_name", "category": "a_category", "district": "a_district"})
    both = (with_coord_key(targets).join(v, ["lat_key", "lng_key"], "left").join(a, ["lat_key", "lng_key"], "left")
            .filter(F.col("v_name").isNotNull() | F.col("a_name").isNotNull()))
    by_venue = F.col("v_name").isNotNull()
    return both.select(*targets.columns, F.coalesce("v_name", "a_name").alias("name"),
                       F.when(by_venue, F.col("v_category")).otherwise(F.col("a_category")).alias("category"),
                       F.coalesce("v_district", "a_district").alias("district"))


def display_places(places: DataFrame, geocoded: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Places with display name, category, district and badge; places without a lookup keep their coordinates."""
    named = geocoded.select(*keys, "cluster_id", F.col("name").alias("_name"), "category", "district")
    return (places.join(named, [*keys, "cluster_id"], "left")
            .withColumns({"display_name": text.display_name("_name", "lat", "lng"),
                          "semantic_badge": lookups.semantic_badge("semantic_label")}).drop("_name"))


def _breakdown(geocoded: DataFrame, by: str, keys: Keys) -> DataFrame:
    return (geocoded.filter(F.coalesce(F.col(by) != "", F.lit(False))).groupBy(*keys, by)
            .agg(F.sum("total_duration_sec").alias("total_duration_sec"), F.count(F.lit(1)).alias("place_count")))


def category_breakdown(geocoded: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Time and number of places per category."""
    return _breakdown(geocoded, "category", keys)


def district_breakdown(geocoded: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Time and number of places per district, with its share of the time that has a district."""
    return share_of_total(_breakdown(geocoded, "district", keys), "total_duration_sec", keys, "share_of_known_time")


def top_breakdown(breakdown: DataFrame, by: str, keys: Keys = SUBJECT, n: int = TOP_BREAKDOWN) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("total_duration_sec"), by)
    return breakdown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
