"""Export documents that keep arriving in a landing folder, appended to a point table.

The per-element rules are stateless, so the batch expressions serve the stream unchanged; order is restored
by the (time, ord) sort of whatever reads the table, as after a batch load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sojourn.sources import exports


def landing_points(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    lines = (spark.readStream.schema(exports.LINES).option("maxFilesPerTrigger", max_files_per_trigger).json(path))
    return exports.points(exports.from_lines(lines))


def append_points(spark: SparkSession, landing: str, table: str, checkpoint: str) -> StreamingQuery:
    """Processes what has landed so far and stops; run again to continue from there."""
    return (landing_points(spark, landing).writeStream.format("parquet").outputMode("append")
            .option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
