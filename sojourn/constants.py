"""Fixed values. They decide results, so they are kept together and stated as they are."""

# --- geometry -------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0

# --- ingest ---------------------------------------------------------------------------
VISIT_SAMPLE_SEC = 300

# --- movement -------------------------------------------------------------------------
WALK_MAX_KMH = 7.0
TRANSIT_MAX_KMH = 30.0
PLAUSIBLE_MAX_KMH = 200.0
STATIONARY_KMH = 1.5
JOURNEY_GAP_SEC = 1500
MODES = ("walk", "transit", "drive", "other")

# --- stays and places -----------------------------------------------------------------
STAY_RADIUS_M = 100.0
STAY_MIN_SEC = 600
STAY_MAX_GAP_SEC = 7200
CLUSTER_EPS_M = 120.0
CLUSTER_MIN_PTS = 4
FREQUENT_PLACE_MATCH_M = 120.0
SIGNIFICANT_STAY_SEC = 900
LIFECYCLE_MIN_VISITS = 4
LIFECYCLE_WINDOW_SHARE = 0.12
LIFECYCLE_WINDOW_MIN_SEC = 14 * 86400
LIFECYCLE_WINDOW_MAX_SEC = 180 * 86400

# --- patterns -------------------------------------------------------------------------
COVERAGE_CELLS_ACROSS = 18
MIN_SPAN_DEG = 1e-6

# --- map layers -----------------------------------------------------------------------
HEAT_CELLS_ACROSS = 300
HEAT_MAX_CELL_M = 120.0
HEAT_QUIET_SHARE = 0.35
HEAT_GAMMA = 0.7
ROUTE_GAP_SEC = 1500
ROUTE_MIN_POINTS = 3
ROUTE_KEEP_WHOLE_BELOW = 8
ROUTE_CELL_M = 40.0
ROUTE_LEVELS = 6
BOUNDS_LOW = 0.02
BOUNDS_HIGH = 0.98
BOUNDS_CELL_DEG = 1e-3
BOUNDS_MIN_SPAN_DEG = 0.002

# --- naming ---------------------------------------------------------------------------
VENUE_RADIUS_M = 80.0
GEOCODE_TARGETS = 25
TOP_PLACES = 6
TOP_BREAKDOWN = 6
TOP_MARKERS = 8
UNKNOWN_PLACE = "unknown place"

# Activity type -> travel mode; any other type counts as "other".
TRAVEL_MODE = {
    "WALKING": "walk",
    "RUNNING": "walk",
    "ON_FOOT": "walk",
    "HIKING": "walk",
    "IN_BUS": "transit",
    "IN_SUBWAY": "transit",
    "IN_TRAM": "transit",
    "IN_TRAIN": "transit",
    "IN_FERRY": "transit",
    "IN_PASSENGER_VEHICLE": "drive",
    "IN_VEHICLE": "drive",
    "IN_ROAD_VEHICLE": "drive",
    "MOTORCYCLING": "drive",
}

# Map feature type -> category label; any other type has no category.
CATEGORY_LABEL = {
    "cafe": "cafe",
    "bar": "bar",
    "pub": "pub",
    "restaurant": "restaurant",
    "fast_food": "fast food",
    "university": "university",
    "college": "college",
    "school": "school",
    "kindergarten": "kindergarten",
    "park": "park",
    "garden": "park",
    "pitch": "sports pitch",
    "stadium": "stadium",
    "playground": "playground",
    "supermarket": "supermarket",
    "convenience": "shop",
    "mall": "shopping centre",
    "department_store": "shopping centre",
    "gym": "gym",
    "fitness_centre": "gym",
    "place_of_worship": "place of worship",
    "hospital": "hospital",
    "clinic": "clinic",
    "pharmacy": "pharmacy",
    "cinema": "cinema",
    "theatre": "theatre",
    "library": "library",
    "hotel": "hotel",
    "office": "office",
    "bank": "bank",
    "hairdresser": "hairdresser",
    "apartments": "residential building",
    "house": "residential building",
}

# Label carried by the history itself -> badge.
SEMANTIC_BADGE = {
    "HOME": "home",
    "WORK": "work",
    "INFERRED_HOME": "home (likely)",
    "INFERRED_WORK": "work (likely)",
    "SCHOOL": "school",
    "INFERRED_SCHOOL": "school (likely)",
}

# Category tokens that describe an area and not a venue.
NON_VENUE_TOKENS = (
    "neighborhood",
    "neighbourhood",
    "city",
    "town",
    "village",
    "state",
    "country",
    "road",
    "street",
    "intersection",
    "postal_code",
    "region",
    "administrative_division",
)
