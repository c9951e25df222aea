"""Ordered work over one key's rows without ever putting that key into one task.

A person's history can be a third of all rows, so ``lag``, running counts and per-person
totals are not written as windows over the person. Rows are split into *chunks* (a time
bucket or an id bucket). Windows run inside a chunk; one small row per chunk carries the
edges and totals across chunks; the join back is on (key, chunk) and so is as balanced as
the chunks are. Only the chunk table, whose size is the number of buckets and not of rows,
is ever windowed by the bare key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.staging import staged

CHUNK = "chunk"
CHUNK_TARGET_ROWS = 100_000
DAY_SEC, QUARTER_SEC = 86_400, 900
# A second with too many rows is cut into so many pieces by ``ord``.
PIECES = 256
ID_BLOCK = 65_536

Keys = Sequence[str]


def with_time_chunk(points: DataFrame, keys: Keys, chunk_sec: int | None = None, target_rows: int | None = None) -> DataFrame:
    """Adds the chunk, a number that grows with (ts_sec, ord). It decides only how work is split, never a result.

    With ``chunk_sec`` all chunks have that width. Otherwise a chunk is one UTC day of a key. Where a key has more than
    ``target_rows`` on a day, that day is cut into quarters of an hour; where a quarter still has more, into seconds; and a second
    with more is cut into ranges of ``ord``. Calm keys and days keep their few chunks. No chunk straddles a UTC day.
    """
    if CHUNK in points.columns:
        return points
    if chunk_sec:
        return points.withColumn(CHUNK, F.floor(F.col("ts_sec") / chunk_sec).cast("bigint"))
    target = target_rows or CHUNK_TARGET_ROWS
    day, quarter = (F.floor(F.col("ts_sec") / n).cast("bigint") for n in (DAY_SEC, QUARTER_SEC))
    per_quarter = points.groupBy(*keys, quarter.alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    days = per_quarter.groupBy(*keys, F.floor(F.col("_q") * QUARTER_SEC / DAY_SEC).cast("bigint").alias("_d")).agg(
        F.sum("_n").alias("_m"), F.collect_set(F.when(F.col("_n") > target, F.col("_q"))).alias("_crowded"))
    days = days.filter(F.col("_m") > target)
    if days.isEmpty():
        return points.withColumn(CHUNK, day)
    days = staged(days.drop("_m"))
    crowded = days.select(*keys, F.explode("_crowded").alias("_q"))
    pieces = [i / PIECES for i in range(1, PIECES)]
    seconds = points.withColumn("_q", quarter).join(crowded, [*keys, "_q"]).groupBy(*keys, "ts_sec").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("ord", pieces, 10 * PIECES).alias("cuts")).filter(F.col("_n") > target)
    hot = seconds.groupBy(*keys, day.alias("_d")).agg(F.collect_list(F.struct("ts_sec", "cuts")).alias("_hot"))
    plan = staged(days.join(hot, [*keys, "_d"], "left"))
    placed = points.withColumn("_d", day).join(plan, [*keys, "_d"], "left")
    burst = F.filter("_hot", lambda h: h["ts_sec"] == F.col("ts_sec"))
    piece = F.when(F.size(burst) > 0, F.size(F.filter(burst[0]["cuts"], lambda c: c < F.col("ord")))).otherwise(0)
    start = (F.when(F.col("_crowded").isNull(), F.col("_d") * DAY_SEC)
             .when(F.array_contains("_crowded", quarter), F.col("ts_sec")).otherwise(quarter * QUARTER_SEC))
    return placed.withColumn(CHUNK, (start * PIECES + F.coalesce(piece, F.lit(0))).cast("bigint")).select(*points.columns, CHUNK)


def with_id_chunk(df: DataFrame, column: str, block: int = ID_BLOCK) -> DataFrame:
    """Adds an id bucket. Ids are unique within a key, so a bucket holds at most ``block`` rows."""
    return df.withColumn(CHUNK, F.floor(F.col(column) / block).cast("bigint"))


def attach_totals(df: DataFrame, keys: Keys, chunk: str = CHUNK,
                  **totals: tuple[Column, Callable[..., Column]]) -> DataFrame:
    """Adds per-key totals to every row: ``name=(partial aggregate, merge function)``."""
    partial = df.groupBy(*keys, chunk).agg(*[p.alias(n) for n, (p, _) in totals.items()])
    whole = Window.partitionBy(*keys)
    table = partial.select(*keys, chunk, *[merge(n).over(whole).alias(n) for n, (_, merge) in totals.items()])
    return df.join(table, [*keys, chunk])


def attach_by_key(df: DataFrame, per_key: DataFrame, keys: Keys, chunk: str = CHUNK, how: str = "inner") -> DataFrame:
    """Joins a one-row-per-key table to many rows per key, spread over the chunks of each key."""
    spread = df.select(*keys, chunk).distinct().join(per_key, list(keys), how)
    return df.join(spread, [*keys, chunk], how)


def scan(df: DataFrame, keys: Keys, carry: Sequence[str], counters: dict[str, str],
         order: Sequence[str] = ("ts_sec", "ord"), chunk: str = CHUNK, counted: Sequence[str] = ()) -> DataFrame:
    """Exact ``prev_*`` columns and running counters over each key's rows in ``order``.

    ``carry`` lists the columns whose previous value is wanted. ``counters`` maps a name to a boolean SQL expression
    over ``carry`` columns ``x`` and their predecessors ``prev_x``; how often it held up to and including the
    row is added under that name. On a key's first row every predecessor is NULL; a NULL condition does not count.
    ``counted`` columns get their number of values in the chunk as ``n_*``.

    The rows and the chunk table read the same columns of the same shuffle, so Spark runs that shuffle once. (The join
    back implies non-null keys; saying so up front keeps both sides' filters, and so their shuffles, the same.)
    """
    df = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, chunk]))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    local = df.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        F.lead(F.lit(True)).over(inside).isNull().alias("_is_last"),
        *[F.lag(c).over(inside).alias(f"prev_{c}") for c in carry],
    )
    if counters:
        local = local.select("*", *[F.expr(f"CAST(_rn > 1 AND coalesce({c}, false) AS BIGINT)").alias(f"_f_{n}")
                                    for n, c in counters.items()])
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = local.select("*", *[F.sum(f"_f_{n}").over(running).alias(f"_s_{n}") for n in counters])

    # One row per chunk: its first and last row, and what it adds to each counter.
    first, last = "_rn = 1", "_is_last"
    edges = local.groupBy(*keys, chunk).agg(
        *[F.count(c).alias(f"n_{c}") for c in counted],
        *[F.expr(f"max({c}) FILTER (WHERE {first}) AS {c}") for c in carry],
        *[F.expr(f"max({c}) FILTER (WHERE {last}) AS _last_{c}") for c in carry],
        *[F.expr(f"sum(_f_{n}) AS _n_{n}") for n in counters],
    )
    across = Window.partitionBy(*keys).orderBy(chunk)
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.select("*", *[F.lag(f"_last_{c}").over(across).alias(f"prev_{c}") for c in carry])
    edges = edges.select("*", *[F.expr(f"CAST(coalesce({c}, false) AS BIGINT)").alias(f"_e_{n}")
                                for n, c in counters.items()])
    counts = [f"n_{c}" for c in counted]
    edges = edges.select(*keys, chunk, *counts, *[F.col(f"prev_{c}").alias(f"_carry_{c}") for c in carry],
                         *[(F.sum(F.expr(f"_n_{n} + _e_{n}")).over(upto) - F.col(f"_n_{n}")).alias(f"_base_{n}")
                           for n in counters])

    return local.join(edges, [*keys, chunk]).select(
        *df.columns, *counts,
        *[F.expr(f"if({first}, _carry_{c}, prev_{c}) AS prev_{c}") for c in carry],
        *[F.expr(f"_base_{n} + _s_{n} AS {n}") for n in counters],
    )
