"""Pairs of point sets by descent: boxes that are refined only where their distance straddles eps.

Every cell is the root of a tree of boxes, four by four to a level. A pair of boxes that is surely within eps, or surely
beyond it, is settled as a whole. The others are split on both sides, level by level, until the points of both are few;
only those are compared point by point. So two crowds that lie eps apart meet along their rims, never n by m.
Equal coordinates are one spot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.constants import EARTH_RADIUS_M
from sojourn.functions import geo
from sojourn.operators.staging import staged

SLACK = 1e-9
#: Levels below a cell; the last one's boxes are a 65,536th of a cell wide.
LEVELS = 8
#: Spots of one box times spots of the other, up to which they are compared one by one.
LEAF = 1 << 14
BOX = (F.min, "lat", "lat_lo"), (F.max, "lat", "lat_hi"), (F.min, "lng", "lng_lo"), (F.max, "lng", "lng_hi")
BOX_NAMES = tuple(name for _, _, name in BOX)
AT = ("row", "col", "box_row", "box_col")


def sided(df: DataFrame, side: str, columns) -> DataFrame:
    return df.withColumnsRenamed({c: f"{side}_{c}" for c in columns})


def box_gap(a: str, b: str) -> tuple[Column, Column]:
    """Lower and upper bound of the distance between points of two nearby boxes ``{a}_lat_lo`` .. ``{b}_lng_hi``."""
    def c(side, name):
        return F.col(f"{side}_{name}")

    apart_lat = F.greatest(c(a, "lat_lo") - c(b, "lat_hi"), c(b, "lat_lo") - c(a, "lat_hi"), F.lit(0.0))
    apart_lng = F.greatest(c(a, "lng_lo") - c(b, "lng_hi"), c(b, "lng_lo") - c(a, "lng_hi"), F.lit(0.0))
    edges = [F.abs(c(s, n)) for s in (a, b) for n in ("lat_lo", "lat_hi")]
    chord = F.cos(F.radians(F.least(F.greatest(*edges), F.lit(90.0)))) * F.sin(F.radians(apart_lng) / 2)
    lower = F.lit(EARTH_RADIUS_M) * F.greatest(F.radians(apart_lat), 2 * F.asin(F.least(chord, F.lit(1.0))))
    upper = geo.box_diagonal_m(F.least(c(a, "lat_lo"), c(b, "lat_lo")), F.greatest(c(a, "lat_hi"), c(b, "lat_hi")),
                               F.least(c(a, "lng_lo"), c(b, "lng_lo")), F.greatest(c(a, "lng_hi"), c(b, "lng_hi")))
    return lower * (1 - SLACK), upper * (1 + SLACK)


def spots_of(placed: DataFrame, k: list[str], height: float, width: Callable[[str], Column]) -> DataFrame:
    """``(keys, row, col, fine_row, fine_col, lat, lng, w, low)``: distinct coordinates with weight, smallest id and place in their cell."""
    fine = 4 ** LEVELS

    def within(x: str, index: str, size: Column) -> Column:
        return F.greatest(F.least(F.floor((F.col(x) / size - F.col(index)) * fine), F.lit(fine - 1)), F.lit(0)).cast("bigint")

    spots = placed.groupBy(*k, "row", "col", "lat", "lng").agg(F.sum("w").alias("w"), F.min("id").alias("low"))
    return spots.withColumns({"fine_row": within("lat", "row", F.lit(height)), "fine_col": within("lng", "col", width("row"))})


def box_of(fine: str, level: int) -> Column:
    return F.shiftright(F.col(fine), 2 * (LEVELS - level)).cast("bigint")


def _boxes(spots: DataFrame, k: list[str], level: int) -> DataFrame:
    """Boxes of a level with their extent, number of spots, weight, one spot as a witness, and the box that they are part of."""
    boxes = spots.groupBy(*k, "row", "col", box_of("fine_row", level).alias("box_row"), box_of("fine_col", level).alias("box_col")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min(F.struct("lat", "lng")).alias("witness"), *[f(c).alias(n) for f, c, n in BOX])
    return boxes.withColumns({"up_row": F.shiftright("box_row", 2), "up_col": F.shiftright("box_col", 2)})


def descend(cells: DataFrame, spots: DataFrame, k: list[str], eps_m: float, settle: str | None = None,
            others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of cells ``(keys, a_row, a_col, b_row, b_col[, more])`` to what is surely within eps, and what is so point by point.

    The first result has a row for each pair of boxes that lie within eps as a whole (``level``, ``a_box_row``, ``a_box_col``, ``b_w``), the
    second one for each pair of spots (``a_lat``, ``a_lng``, ``b_w``); both carry the sides' cells and the pair's further columns.
    With ``settle`` (two of these columns, by name) one witness is enough: pairs of equal values are done as soon as
    any two spots are known to lie within eps, and every found row stands for all of them. ``others`` are the spots of
    the cells b where they are not those of the cells a.
    """
    names = [c for c in cells.columns if c not in k]
    extra = [c for c in names if c not in ("a_row", "a_col", "b_row", "b_col")]
    lower, upper = box_gap("a", "b")
    own = {"a": spots, "b": spots if others is None else others}
    sides = {s: [f"{s}_{c}" for c in AT] for s in "ab"}
    pairs = cells.select(*cells.columns, *[F.lit(0).cast("bigint").alias(f"{s}_box_{x}") for s in "ab" for x in ("row", "col")])
    sure = near = None
    for level in range(LEVELS + 1):
        if level == 1:  # from here on only the cells of the pairs left over
            for s, df in own.items():
                touched = pairs.select(*k, F.col(f"{s}_row").alias("row"), F.col(f"{s}_col").alias("col")).distinct()
                own[s] = staged(df.join(touched, [*k, "row", "col"], "left_semi"))
        boxes = {s: _boxes(df, k, level) for s, df in own.items()}
        carried = [*AT, "n", "w", "witness", *BOX_NAMES]
        if level:  # the parts of the pairs left over
            for s in "ab":
                part = sided(boxes[s].select(*k, *carried, "up_row", "up_col"), s, [*carried, "up_row", "up_col"])
                part = part.withColumnsRenamed({f"{s}_up_row": f"{s}_of_row", f"{s}_up_col": f"{s}_of_col"})
                pairs = pairs.withColumnsRenamed({f"{s}_box_row": f"{s}_of_row", f"{s}_box_col": f"{s}_of_col"})
                pairs = pairs.join(part, [*k, f"{s}_row", f"{s}_col", f"{s}_of_row", f"{s}_of_col"]).drop(f"{s}_of_row", f"{s}_of_col")
        else:
            for s in "ab":
                pairs = pairs.join(sided(boxes[s].select(*k, *carried), s, carried), [*k, *sides[s]])
        within = upper <= eps_m
        if settle:
            within = within | (geo.haversine_m("a_witness.lat", "a_witness.lng", "b_witness.lat", "b_witness.lng") <= eps_m)
        pairs = pairs.withColumns({"lower": lower, "sure": within}).filter(F.col("lower") <= eps_m)
        if settle:
            pairs = pairs.withColumn("sure", F.max("sure").over(Window.partitionBy(*k, *settle.split())))
        small = F.lit(level == LEVELS) | (F.col("a_n") * F.col("b_n") <= LEAF)
        pairs = staged(pairs.select(*k, *extra, *sides["a"], *sides["b"], "b_w", "sure", small.alias("small")))
        done = pairs.filter("sure").select(*k, *extra, F.lit(level).alias("level"), *sides["a"], "b_row", "b_col", "b_w")
        sure = done if sure is None else sure.unionByName(done)
        left = pairs.filter("NOT sure").drop("b_w", "sure")
        found = _by_spot(left.filter("small").drop("small"), own, k, eps_m, level, extra)
        near = found if near is None else near.unionByName(found)
        pairs = left.filter("NOT small").drop("small")
        if pairs.isEmpty():
            break
    return sure, near


def _by_spot(pairs: DataFrame, spots: dict[str, DataFrame], k: list[str], eps_m: float, level: int, extra: list[str]) -> DataFrame:
    columns = [*AT, "lat", "lng", "w"]
    for s, df in spots.items():
        own = df.select(*k, "row", "col", box_of("fine_row", level).alias("box_row"), box_of("fine_col", level).alias("box_col"), "lat", "lng", "w")
        pairs = pairs.join(sided(own, s, columns), [*k, *[f"{s}_{c}" for c in AT]])
    meters = geo.haversine_m("a_lat", "a_lng", "b_lat", "b_lng")
    return pairs.filter(meters <= eps_m).select(*k, *extra, "a_row", "a_col", "b_row", "b_col", "a_lat", "a_lng", "b_w")
