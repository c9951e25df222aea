"""Tables that already have the point schema, and the sink for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions import geo

POINTS = {"subject_id": "string", "ord": "bigint", "lat": "double", "lng": "double", "ts_sec": "bigint",
          "source": "string", "semantic_label": "string"}


def points_from_table(df: DataFrame) -> DataFrame:
    """Checks and casts a table to the point schema; rows with impossible coordinates or no time are dropped."""
    missing = [c for c in POINTS if c not in df.columns]
    if missing:
        raise ValueError(f"not a point table, columns missing: {missing}")
    typed = df.select(*[F.col(c).cast(t).alias(c) for c, t in POINTS.items()])
    return typed.filter(geo.valid_coordinate("lat", "lng") & F.col("ts_sec").isNotNull()
                        & F.col("source").isin("movement", "visit"))


def read_points(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(", ".join(f"{c} {t}" for c, t in POINTS.items()))
    return points_from_table(reader.load(path))


def write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by UTC month, range-sorted by person and time: time filters prune files, and no person is one file."""
    month = F.date_format(F.timestamp_seconds("ts_sec"), "yyyy-MM")
    (points.withColumn("month", month).repartitionByRange("month", "subject_id", "ts_sec")
     .sortWithinPartitions("month", "subject_id", "ts_sec", "ord")
     .write.mode(mode).partitionBy("month").parquet(path))
