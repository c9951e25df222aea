"""Location-history analytics on Spark: DataFrame in, DataFrame out.

Every operator takes a table of timed points (or something derived from one) that
holds *many* people, identified by key columns (``subject_id`` and, when several
periods are computed at once, ``period_key``).
"""

from sojourn.functions import calendar, geo, lookups, text
from sojourn.operators import (
    clustering,
    enrichment,
    maplayers,
    movement,
    patterns,
    places,
    selection,
    stays,
)
from sojourn.plans import profile
from sojourn.sources import exports, tables

__all__ = [
    "calendar", "geo", "lookups", "text",
    "clustering", "enrichment", "maplayers", "movement", "patterns", "places", "selection", "stays",
    "profile", "exports", "tables",
]
