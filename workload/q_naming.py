"""Venue and address joins, display rows, category and district breakdowns."""

from pyspark.sql import functions as F

from sojourn.operators import enrichment, places, selection
from workload.fixtures import Inputs
from workload.registry import cte, hav, query

cte("keyed", """SELECT *, CAST(floor(lat * 1E4 + 0.5) AS BIGINT) AS lat_key, CAST(floor(lng * 1E4 + 0.5) AS BIGINT) AS lng_key FROM targets""", "targets")
cte("nearest", f"""SELECT lat_key, lng_key, venue_id, meters FROM (SELECT k.lat_key, k.lng_key, v.venue_id, m.meters,
      row_number() OVER (PARTITION BY k.lat_key, k.lng_key ORDER BY m.meters, v.venue_id) AS rn
    FROM (SELECT DISTINCT lat_key, lng_key FROM keyed) k CROSS JOIN venues v,
      LATERAL (SELECT {hav('k.lat_key / 1E4', 'k.lng_key / 1E4', 'v.lat', 'v.lng')} AS meters) m WHERE m.meters <= 80) WHERE rn = 1""",
    "keyed", "venues")
cte("tokens", """SELECT venue_id, n, nullif(trim(regexp_replace(lower(strip_accents(part)), '[^a-z0-9]+', '_', 'g'), '_'), '') AS token FROM (
      SELECT venue_id, unnest(string_split(categories, ',')) AS part, generate_subscripts(string_split(categories, ','), 1) AS n FROM venues)""", "venues")
cte("useful", """SELECT v.venue_id, trim(v.name) AS name, t.token AS type, nullif(trim(v.neighborhood), '') AS district FROM venues v
    LEFT JOIN (SELECT venue_id, arg_min(token, n) AS token FROM tokens WHERE token NOT IN (SELECT token FROM non_venue) GROUP BY 1) t
      ON t.venue_id = v.venue_id
    WHERE trim(v.name) <> '' AND (t.token IS NOT NULL OR v.venue_id NOT IN (SELECT venue_id FROM tokens WHERE token IS NOT NULL))""",
    "venues", "tokens", "non_venue")
cte("address_names", """SELECT a.lat_key, a.lng_key, coalesce(nullif(name, ''), nullif(trim(concat_ws(' ', nullif(road, ''), nullif(house_number, ''))), ''),
      nullif(split_part(display_name, ',', 1), ''), 'unknown place') AS name, l.label AS category,
      coalesce(city_district, borough, suburb, neighbourhood, quarter) AS district
    FROM addresses a LEFT JOIN category_label l ON l.type = a.type""", "addresses", "category_label")
cte("addressed", """SELECT k.subject_id, k.cluster_id, k.lat, k.lng, k.total_duration_sec, a.name, a.category, a.district
    FROM keyed k JOIN address_names a ON a.lat_key = k.lat_key AND a.lng_key = k.lng_key""", "keyed", "address_names")
cte("two_tier", """SELECT k.subject_id, k.cluster_id, k.lat, k.lng, k.total_duration_sec, coalesce(u.name, a.name) AS name,
      CASE WHEN u.name IS NOT NULL THEN l.label ELSE a.category END AS category, coalesce(u.district, a.district) AS district
    FROM keyed k LEFT JOIN nearest n ON n.lat_key = k.lat_key AND n.lng_key = k.lng_key LEFT JOIN useful u ON u.venue_id = n.venue_id
    LEFT JOIN category_label l ON l.type = u.type
    LEFT JOIN address_names a ON a.lat_key = k.lat_key AND a.lng_key = k.lng_key
    WHERE u.name IS NOT NULL OR a.name IS NOT NULL""", "keyed", "nearest", "useful", "category_label", "address_names")


@query("nearest_venue", "SELECT lat_key, lng_key, venue_id, round(meters, 4) AS meters FROM nearest", "nearest")
def _(t: Inputs):
    return enrichment.nearest_venue(t.targets, t.venues).withColumn("meters", F.round("meters", 4))


@query("venue_filter", """SELECT k.subject_id, k.cluster_id, u.venue_id, u.name, u.type, u.district FROM keyed k
    JOIN nearest n ON n.lat_key = k.lat_key AND n.lng_key = k.lng_key JOIN useful u ON u.venue_id = n.venue_id""", "keyed", "nearest", "useful")
def _(t: Inputs):
    named = enrichment.nearest_venue(t.targets, t.venues).join(enrichment.venue_filter(t.venues), "venue_id")
    return enrichment.with_coord_key(t.targets).join(named, ["lat_key", "lng_key"]).select(
        "subject_id", "cluster_id", "venue_id", "name", "type", "district")


_NAMED = "subject_id, cluster_id, total_duration_sec, name, category, district"


@query("address_lookup", f"SELECT {_NAMED} FROM addressed", "addressed")
def _(t: Inputs):
    return enrichment.address_lookup(t.targets, t.addresses).select(*_NAMED.split(", "))


def _two_tier(t: Inputs):
    return enrichment.two_tier_names(t.targets, t.venues, t.addresses)


@query("two_tier_names", f"SELECT {_NAMED} FROM two_tier", "two_tier")
def _(t: Inputs):
    return _two_tier(t).select(*_NAMED.split(", "))


_SEM = "CASE cluster_id % 5 WHEN 0 THEN 'HOME' WHEN 1 THEN 'INFERRED_WORK' WHEN 2 THEN 'SEARCHED_ADDRESS' END"
cte("display", f"""SELECT k.subject_id, k.cluster_id, k.total_duration_sec, coalesce(g.name, printf('%.3f, %.3f', k.lat, k.lng)) AS display_name,
      g.category, g.district, b.badge AS semantic_badge
    FROM (SELECT *, {_SEM} AS sem FROM keyed) k LEFT JOIN addressed g ON g.subject_id = k.subject_id AND g.cluster_id = k.cluster_id
    LEFT JOIN semantic_badge b ON b.label = k.sem""", "keyed", "addressed", "semantic_badge")
_SHOWN = "subject_id, cluster_id, total_duration_sec, display_name, category, district, semantic_badge"


def _display(t: Inputs):
    labelled = t.targets.withColumn("semantic_label", F.expr(_SEM))
    return enrichment.display_places(labelled, enrichment.address_lookup(t.targets, t.addresses))


@query("display_places", f"SELECT {_SHOWN} FROM display", "display")
def _(t: Inputs):
    return _display(t).select(*_SHOWN.split(", "))


@query("keep_significant_display", f"""SELECT {_SHOWN} FROM display d WHERE (subject_id, cluster_id) IN (SELECT (subject_id, cluster_id) FROM (
    SELECT *, bool_or(total_duration_sec >= 18000) OVER (PARTITION BY subject_id) AS m FROM targets) WHERE total_duration_sec >= 18000 OR NOT m)""",
       "display", "targets")
def _(t: Inputs):
    return selection.keep_significant_display(_display(t), selection.significant_places(t.targets, min_sec=18000)).select(*_SHOWN.split(", "))


cte("by_category", """SELECT subject_id, category, CAST(sum(total_duration_sec) AS BIGINT) AS total_duration_sec, count(*) AS place_count
    FROM two_tier WHERE category <> '' GROUP BY ALL""", "two_tier")
cte("by_district", """SELECT *, total_duration_sec / sum(total_duration_sec) OVER (PARTITION BY subject_id) AS share_of_known_time FROM (
      SELECT subject_id, district, CAST(sum(total_duration_sec) AS BIGINT) AS total_duration_sec, count(*) AS place_count
      FROM two_tier WHERE district <> '' GROUP BY ALL)""", "two_tier")


@query("category_breakdown", "SELECT * FROM by_category", "by_category")
def _(t: Inputs):
    return enrichment.category_breakdown(_two_tier(t))


_DISTRICT = "subject_id, district, total_duration_sec, place_count, round(share_of_known_time, 6) AS share_of_known_time"


@query("district_breakdown", f"SELECT {_DISTRICT} FROM by_district", "by_district")
def _(t: Inputs):
    return enrichment.district_breakdown(_two_tier(t)).withColumn("share_of_known_time", F.round("share_of_known_time", 6))


@query("share_of_total", """SELECT subject_id, cluster_id, round(total_duration_sec / sum(total_duration_sec) OVER (PARTITION BY subject_id), 6) AS share_of_total
    FROM targets""", "targets")
def _(t: Inputs):
    return places.share_of_total(t.targets, "total_duration_sec").select("subject_id", "cluster_id", F.round("share_of_total", 6).alias("share_of_total"))


def _top(name: str, table: str, by: str, breakdown):
    @query(name, f"""SELECT subject_id, {by}, total_duration_sec, place_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
        ORDER BY total_duration_sec DESC, {by}) AS rank FROM {table}) WHERE rank <= 6""", table)
    def _(t: Inputs):
        return enrichment.top_breakdown(breakdown(_two_tier(t)), by).select("subject_id", by, "total_duration_sec", "place_count", "rank")


_top("top_categories", "by_category", "category", enrichment.category_breakdown)
_top("top_districts", "by_district", "district", enrichment.district_breakdown)
