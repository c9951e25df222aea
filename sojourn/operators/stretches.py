"""Stay detection in one long island by many tasks: a speculative scan.

The anchor scan depends on where it comes from, but two scans of one track that ever stand on the same anchor go on alike. So an
island is cut into pieces of consecutive points, and each piece is scanned from its own first point, on through the next piece, up to
the first anchor that the next piece's scan stands on too. If all neighbours meet, the true scan is the first piece's up to its
meeting point, then the second piece's up to its own, and so on.

Where a scan does not meet the next (a stay that outlasts a piece, say), it is walked on through a longer stretch of pieces, three
times as long in each round, whose inner pieces are given up. Only such stretches are read again, each as a stream of
constant memory; a stretch that reaches the island's end needs no meeting.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.anchor import speculative_scan
from sojourn.operators.ordered import Keys
from sojourn.operators.staging import staged, staged_table

PIECE_ROWS = 8_192
COLUMNS = ("final_piece", "stretch", "upto", "meet", "round")
STAY = "start_sec bigint, end_sec bigint, lat double, lng double, point_count bigint, semantic_label string"


def extended(stretches: list[tuple], final: int) -> list[tuple]:
    """The next round of an island's stretches ``(first, upto, meet, round)``, in order and each up to the next one's first piece.

    Stretches that met stay as they are. The others, marked True, grow threefold over those that follow, and end where one
    of the rest begins or after the island's ``final`` piece.
    """
    out, i = [], 0
    while i < len(stretches):
        first, upto, meet, number = stretches[i]
        i += 1
        if meet is not None or upto > final:
            out.append((first, upto, meet, number, False))
            continue
        upto = min(first + 3 * (upto - first), final + 1)
        while i < len(stretches) and stretches[i][0] < upto:
            upto = max(upto, stretches[i][1])
            i += 1
        out.append((first, upto, None, number + 1, True))
    return out


def _extend(groups: DataFrame, keys: Keys, fields: list[str]) -> DataFrame:
    names = ["stretch", "upto", "meet", "round", "again"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("stretch")
        final = rows.column("final_piece")[0].as_py()
        made = extended(list(zip(*(rows.column(c).to_pylist() for c in names[:-1]))), final)
        same = {c: pa.array([rows.column(c)[0].as_py()] * len(made), rows.schema.field(c).type) for c in [*keys, "island", "final_piece"]}
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.table(same | {c: pa.array([m[i] for m in made], kind) for i, (c, kind) in enumerate(zip(names, kinds))})

    schema = ", ".join([*fields, "island bigint, final_piece bigint, stretch bigint, upto bigint, meet bigint, round bigint, again boolean"])
    return groups.groupBy(*keys, "island").applyInArrow(run, schema)


def linked(plan: DataFrame, found: DataFrame, own: list[str]) -> DataFrame:
    """The stretches of a round with the points where they meet the next ones."""
    meets = found.filter("start_sec IS NULL").select(*own, "stretch", F.col("pos").alias("meet"))
    return plan.join(meets, [*own, "stretch"]).select(*own, *COLUMNS)


def speculative_stays(rows: DataFrame, keys: Keys, radius_m: float, min_sec: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(keys, start_sec, end_sec, lat, lng, point_count, semantic_label)`` of whole islands.

    ``rows``: keys, ``island``, ``pos`` (consecutive), ``ts_sec``, ``lat``, ``lng``, ``semantic_label``, and the island's ``first_pos`` and ``last_pos``.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys]
    own = [*keys, "island"]
    piece = {c: F.floor(F.col(p) / piece_rows).cast("bigint") for c, p in (("piece", "pos"), ("first_piece", "first_pos"), ("final_piece", "last_pos"))}
    rows = staged_table(rows.withColumns(piece).drop("first_pos", "last_pos"))
    schema = ", ".join([*fields, "island bigint, stretch bigint, pos bigint", STAY])

    def walk(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select(*own, "stretch", "pos", "ts_sec", "lat", "lng", "semantic_label",
                             (F.col("piece") == F.col("upto")).alias("last"), (F.col("upto") >= F.col("final_piece")).alias("final"))
        placed = dealt.repartition(*own, "stretch").sortWithinPartitions(*own, "stretch", "pos")
        return staged_table(placed.mapInArrow(speculative_scan(list(keys), radius_m, min_sec), schema))

    first = rows.withColumn("stretch", F.explode(F.array(F.col("piece") - 1, F.col("piece")))).filter("stretch >= first_piece")
    found = walk(first.withColumn("upto", F.col("stretch") + 1))
    plan = rows.select(*own, "final_piece", F.col("piece").alias("stretch")).distinct().select(
        "*", (F.col("stretch") + 1).alias("upto"), F.lit(1).cast("bigint").alias("round"))
    stays = found.filter("start_sec IS NOT NULL").withColumn("round", F.lit(1).cast("bigint"))

    groups = staged(linked(plan, found, own))
    while not (open_ := groups.filter("meet IS NULL AND upto <= final_piece").select(*own).distinct()).isEmpty():
        plan = staged(_extend(groups.join(open_, own, "left_semi"), keys, fields))
        again = plan.filter("again").drop("meet", "again")
        pieces = again.select(*own, "stretch", "upto", F.explode(F.expr("sequence(stretch, least(upto, final_piece))")).alias("piece"))
        found = walk(rows.join(pieces, [*own, "piece"]))
        number = plan.select("round", "again", *own, "stretch")
        stays = stays.unionByName(found.filter("start_sec IS NOT NULL").join(number.filter("again").drop("again"), [*own, "stretch"])
                                  .select(*stays.columns))
        groups = staged(groups.join(open_, own, "left_anti").unionByName(plan.filter("NOT again").select(*own, *COLUMNS))
                        .unionByName(linked(again, found, own)))
    entry = groups.select(*own, F.col("upto").alias("stretch"), F.col("meet").alias("entry"))
    true = groups.join(entry, [*own, "stretch"], "left").select(*own, "stretch", "round", F.coalesce("entry", F.lit(-1)).alias("entry"))
    kept = stays.join(true, [*own, "stretch", "round"]).filter(F.col("pos") >= F.col("entry"))
    return kept.select(*keys, "start_sec", "end_sec", "lat", "lng", "point_count", "semantic_label")
