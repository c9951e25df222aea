"""Small fixed vocabularies as column expressions and as tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.constants import CATEGORY_LABEL, NON_VENUE_TOKENS, SEMANTIC_BADGE, TRAVEL_MODE


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, key)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def travel_mode(raw_type) -> Column:
    return F.coalesce(_lookup(TRAVEL_MODE, F.upper(_col(raw_type))), F.lit("other"))


def category_label(feature_type) -> Column:
    return _lookup(CATEGORY_LABEL, _col(feature_type))


def semantic_badge(label) -> Column:
    return _lookup(SEMANTIC_BADGE, F.upper(_col(label)))


def non_venue_tokens() -> Column:
    return F.array(*[F.lit(t) for t in NON_VENUE_TOKENS])


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """A vocabulary as a two-column table, for callers that would rather join."""
    known = {
        "travel_mode": (TRAVEL_MODE, "raw_type string, mode string"),
        "category_label": (CATEGORY_LABEL, "type string, label string"),
        "semantic_badge": (SEMANTIC_BADGE, "label string, badge string"),
    }
    mapping, schema = known[name]
    return spark.createDataFrame(list(mapping.items()), schema)
