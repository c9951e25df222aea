"""Choosing rows: by source, by period, by significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import SIGNIFICANT_STAY_SEC
from sojourn.functions import calendar
from sojourn.operators.ordered import CHUNK, Keys, attach_totals, with_time_chunk

SUBJECT = ("subject_id",)


def select_source(points: DataFrame, source: str) -> DataFrame:
    return points.filter(F.col("source") == source)


def movement_points(points: DataFrame, keys: Keys = SUBJECT, chunk_sec: int | None = None) -> DataFrame:
    """Movement rows, or all rows of a key that has none. Keeps the ``chunk`` column for what follows."""
    chunked = with_time_chunk(points, keys, chunk_sec)
    is_movement = F.col("source") == "movement"
    flagged = attach_totals(chunked, keys, CHUNK, _moves=(F.max(is_movement), F.max))
    return flagged.filter(is_movement | ~F.col("_moves")).drop("_moves")


def range_filter(df: DataFrame, period_key: str, tz: str = "UTC", time_column: str = "ts_sec") -> DataFrame:
    """Rows that fall (points) or start (activities, trips) inside a period; plain bounds, so they reach the scan."""
    bounds = calendar.period_bounds(period_key, tz)
    if bounds is None:
        return df
    start, end = bounds
    return df.filter((F.col(time_column) >= start) & (F.col(time_column) < end))


def period_explode(df: DataFrame, tz: str = "UTC", time_column: str = "ts_sec") -> DataFrame:
    """Each row once per period it belongs to, so that one job computes every period."""
    return df.withColumn("period_key", F.explode(calendar.period_keys(time_column, tz)))


def significant_places(places: DataFrame, keys: Keys = SUBJECT, min_sec: int = SIGNIFICANT_STAY_SEC) -> DataFrame:
    """Places with enough time, or all places of a key that has none such."""
    enough = F.col("total_duration_sec") >= min_sec
    return (places.withColumn("_any", F.max(enough).over(Window.partitionBy(*keys)))
            .filter(enough | ~F.col("_any")).drop("_any"))


def keep_significant_display(display: DataFrame, significant: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return display.join(significant.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_semi")


def sort_by_time(points: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return points.orderBy(*keys, "ts_sec", "ord")
