"""Distributed results against the sequential definitions on random input."""

import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import boxes, clustering, maplayers, movement, stays
from sojourn.operators.components import components
from sojourn.operators.ordered import scan, with_time_chunk
from tests import reference_rules as rules


def wander(seed, n, subject):
    """Dwelling with jitter, slow drifts, walks and silences."""
    rng = random.Random(seed)
    ts, lat, lng, out = 1_700_000_000 + rng.randrange(5000), 50.0, 30.0, []
    home = (lat, lng)
    while len(out) < n:
        kind = rng.choice(["dwell", "dwell", "drift", "walk", "gap", "burst"])
        steps = rng.randrange(3, 60)
        for _ in range(steps):
            if kind == "dwell":
                ts += rng.choice([0, 30, 120, 300])
                lat, lng = home[0] + rng.gauss(0, 0.0004), home[1] + rng.gauss(0, 0.0006)
            elif kind == "drift":
                ts += 60
                lat += 0.0003
            elif kind == "walk":
                ts += rng.choice([20, 60])
                lat, lng = lat + rng.uniform(-0.0012, 0.0012), lng + 0.001
            elif kind == "burst":
                ts += 1
                lng += 0.00002
            else:
                ts += rng.choice([7199, 7200, 7201, 20000])
            out.append((ts, lat, lng, "movement", rng.choice([None, None, "HOME", "WORK"]), subject))
        if kind in ("walk", "drift"):
            home = (lat, lng)
    return out[:n]


@pytest.mark.parametrize("chunk_sec", [86400, 900, 60])
def test_stays_match_the_sequential_scan(spark, make_points, chunk_sec):
    tracks = {f"s{k}": wander(k, 700, f"s{k}") for k in range(6)}
    points = make_points([p for t in tracks.values() for p in t]).repartition(7)
    got = {}
    for r in stays.stay_points(points, chunk_sec=chunk_sec).orderBy("subject_id", "sid").collect():
        got.setdefault(r.subject_id, []).append((r.start_sec, r.end_sec, r.point_count, r.semantic_label))
    for subject, track in tracks.items():
        assert got.get(subject, []) == rules.stays([(p[0], p[1], p[2], p[4]) for p in track])


def test_stay_kernel_carries_state_over_small_batches(spark, make_points):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        track = wander(99, 900, "a")
        got = stays.stay_points(make_points(track)).orderBy("sid").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rules.stays([(p[0], p[1], p[2], p[4]) for p in track])
    assert [(r.start_sec, r.end_sec, r.point_count, r.semantic_label) for r in got] == want


def spots_of(seed, n, lat, spread_m):
    rng = random.Random(seed)
    hubs = [(rng.uniform(0, spread_m), rng.uniform(0, spread_m)) for _ in range(max(2, n // 25))]
    out = []
    for _ in range(n):
        x, y = rng.choice(hubs)
        scale = rng.choice([5, 40, 120])
        dy, dx = y + rng.gauss(0, scale), x + rng.gauss(0, scale)
        out.append((lat + dy / 111_195, 10 + dx / (111_195 * max(0.02, __import__("math").cos(__import__("math").radians(lat))))))
    return out


CASES = [(1, 200, 50.0, 1500), (2, 300, 0.0, 900), (3, 260, -62.0, 1200), (4, 240, 84.0, 1500), (5, 300, 50.0, 300)]


def frame(spark, cases):
    rows = [(f"c{seed}", i, la, ln, float(1 + i % 3)) for seed, n, lat, spread in cases
            for i, (la, ln) in enumerate(spots_of(seed, n, lat, spread))]
    return spark.createDataFrame(rows, "subject_id string, sid bigint, lat double, lng double, w double")


def test_clusters_match_breadth_first_search(spark):
    items = frame(spark, CASES)
    plain = {(r.subject_id, r.sid): r.cluster_id for r in clustering.dbscan(items).collect()}
    heavy = {(r.subject_id, r.sid): r.cluster_id for r in clustering.dbscan(items, min_pts=14, weight_col="w").collect()}
    moved = {(r.subject_id, r.sid): r.cluster_id for r in clustering.dbscan(items.repartition(13)).collect()}
    assert plain == moved
    for seed, n, lat, spread in CASES:
        spots = spots_of(seed, n, lat, spread)
        assert [plain[f"c{seed}", i] for i in range(n)] == rules.clusters(spots, 120, 4)
        assert [heavy[f"c{seed}", i] for i in range(n)] == rules.clusters(spots, 120, 14, [1 + i % 3 for i in range(n)])


def test_undecided_cell_pairs_are_settled_point_by_point(spark):
    """Two dense strips whose nearest points are just within, and just beyond, eps."""
    rows, want = [], {}
    for name, gap in (("in", 119.5), ("out", 121.5)):
        spots = [(50 + i * 1e-6, 10.0) for i in range(6)] + [(50 + i * 1e-6 + (gap / 111_194.9), 10.0) for i in range(6)]
        rows += [(name, i, la, ln) for i, (la, ln) in enumerate(spots)]
        want.update({(name, i): c for i, c in enumerate(rules.clusters(spots, 120, 4))})
    items = spark.createDataFrame(rows, "subject_id string, sid bigint, lat double, lng double")
    assert {(r.subject_id, r.sid): r.cluster_id for r in clustering.dbscan(items).collect()} == want
    assert want["in", 11] == 0 and want["out", 11] == 1


def test_neighbour_weights(spark):
    items = frame(spark, CASES[:2])
    got = {(r.subject_id, r.sid): r.weight for r in clustering.eps_neighbour_weights(items, weight_col="w").collect()}
    for seed, n, lat, spread in CASES[:2]:
        spots = spots_of(seed, n, lat, spread)
        for i in range(n):
            near = [j for j in range(n) if rules.meters(*spots[i], *spots[j]) <= 120]
            assert got[f"c{seed}", i] == sum(1 + j % 3 for j in near)


@pytest.mark.parametrize("leaf", [1])
def test_boxes_are_refined_down_to_single_spots(spark, monkeypatch, leaf):
    monkeypatch.setattr(boxes, "LEAF", leaf)
    items = frame(spark, CASES[:2])
    got = {(r.subject_id, r.sid): r.weight for r in clustering.eps_neighbour_weights(items, weight_col="w").collect()}
    found = {(r.subject_id, r.sid): r.cluster_id for r in clustering.dbscan(items).collect()}
    for seed, n, lat, spread in CASES[:2]:
        spots = spots_of(seed, n, lat, spread)
        for i in range(n):
            assert got[f"c{seed}", i] == sum(1 + j % 3 for j in range(n) if rules.meters(*spots[i], *spots[j]) <= 120)
        assert [found[f"c{seed}", i] for i in range(n)] == rules.clusters(spots, 120, 4)


@pytest.mark.parametrize("apart,clusters", [(119.0, 1), (120.5, 2)])
def test_two_crowds_about_eps_apart_never_meet_point_by_point(spark, monkeypatch, apart, clusters):
    """20,000 stays on either side: few pairs of boxes, and no more pairs of spots than a few leaves hold."""
    n = 20_000
    side = F.col("id") % 2
    items = spark.range(2 * n).select(
        F.lit("a").alias("subject_id"), F.col("id").alias("sid"),
        (50 + F.when(side == 0, -F.rand(1) * 20).otherwise(apart + F.rand(2) * 20) / 111_194.9).alias("lat"), (10 + F.rand(3) * 25 / 71_474).alias("lng"))
    items = spark.createDataFrame(items.toPandas(), items.schema)
    compared, plain = [], boxes._by_spot

    def counted(pairs, spots, k, *rest):
        both = pairs
        for s, own in spots.items():
            size = boxes._boxes(own, k, rest[1]).select(*k, *boxes.AT, "n")
            both = both.join(boxes.sided(size, s, [*boxes.AT, "n"]), [*k, *[f"{s}_{c}" for c in boxes.AT]])
        compared.append(both.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0)
        return plain(pairs, spots, k, *rest)

    monkeypatch.setattr(boxes, "_by_spot", counted)
    found = clustering.dbscan(items)
    assert found.select("cluster_id").distinct().count() == clusters and found.filter("cluster_id < 0").count() == 0
    assert sum(compared) < n * 200


@pytest.mark.parametrize("light", [0.0001])
def test_light_points_by_the_thousand_form_no_pairs(spark, light):
    """A thin cell of 30,000 points that weigh next to nothing, near a heavy place: all are border points or core by their place alone."""
    n = 30_000
    rows = spark.range(n).select(F.lit("a").alias("subject_id"), F.col("id").alias("sid"), (50 + F.rand(1) * 30 / 111_194.9).alias("lat"),
                                 (10 + F.rand(2) * 20 / 71_474).alias("lng"), F.lit(light).alias("w"))
    heavy = spark.createDataFrame([("a", n + i, 50 + 80 / 111_194.9, 10.0, 2.0) for i in range(3)], rows.schema)
    alone = spark.createDataFrame([("a", n + 9, 51.0, 10.0, light)], rows.schema)
    items = rows.unionByName(heavy).unionByName(alone)
    found = clustering.dbscan(spark.createDataFrame(items.toPandas(), items.schema), weight_col="w", min_pts=4)
    assert {(r.cluster_id, r["count"]) for r in found.groupBy("cluster_id").count().collect()} == {(0, n + 3), (-1, 1)}


def test_negative_weights_are_an_error(spark):
    items = spark.createDataFrame([("a", 0, 50.0, 10.0, -1.0)], "subject_id string, sid bigint, lat double, lng double, w double")
    with pytest.raises(Exception, match="weights must be"):
        clustering.dbscan(items, weight_col="w").collect()


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(5)
    edges = [("a", i, i + 1) for i in range(60)] + [("a", 500, 500 + i) for i in range(1, 80)] + [("b", 3, 1), ("b", 2, 3)]
    rng.shuffle(edges)
    frame_ = spark.createDataFrame(edges, "subject_id string, u bigint, v bigint")
    got = {(r.subject_id, r.node): r.root for r in components(frame_, ["subject_id"]).collect()}
    assert all(got["a", i] == 0 for i in range(61)) and all(got["a", 500 + i] == 500 for i in range(80))
    assert [got["b", i] for i in (1, 2, 3)] == [1, 1, 1]


@pytest.mark.parametrize("chunk_sec", [86400, 60, 1])
def test_scan_equals_a_plain_window(spark, make_points, chunk_sec):
    points = make_points(wander(3, 400, "a") + wander(4, 300, "b"))
    chunked = with_time_chunk(points, ["subject_id"], chunk_sec)
    got = scan(chunked, ["subject_id"], ("ts_sec", "lat"), {"n": "ts_sec - prev_ts_sec > 100 OR prev_ts_sec IS NULL"})
    points.createOrReplaceTempView("scan_points")
    want = spark.sql("""SELECT subject_id, ord, p, sum(CASE WHEN p IS NULL OR ts_sec - p > 100 THEN 1 ELSE 0 END)
        OVER (PARTITION BY subject_id ORDER BY ts_sec, ord) AS n FROM (SELECT *, lag(ts_sec)
        OVER (PARTITION BY subject_id ORDER BY ts_sec, ord) AS p FROM scan_points)""")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("subject_id", "ord", "prev_ts_sec", "n").collect()), key=key) == sorted(
        map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("chunk_sec", [86400, 60])
def test_results_do_not_depend_on_the_chunk_width(spark, make_points, chunk_sec):
    points = make_points(wander(8, 600, "a") + wander(9, 500, "b"))

    def shown(df, *cols):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())

    for build, cols in (
        (lambda c: movement.journeys(points, chunk_sec=c), ("subject_id", "start_sec", "end_sec", "km")),
        (lambda c: maplayers.routes(points, chunk_sec=c, min_points=1), ("subject_id", "segment_id", "idx", "segment_len", "ord")),
        (lambda c: maplayers.route_density(maplayers.routes(points, chunk_sec=c)), ("subject_id", "a_lat", "b_lng", "passes")),
    ):
        assert shown(build(chunk_sec), *cols) == shown(build(21600), *cols)


def test_bursts_are_cut_by_time_and_then_by_order(make_points):
    rng = random.Random(7)
    rows = [(1704067200 + 3600, 50 + rng.random(), 30) for _ in range(3000)]  # one second
    rows += [(1704067200 + 7200 + i // 20, 50 + rng.random() / 1e3, 30) for i in range(2000)]  # a hundred seconds
    rows += [(1704067200 + 86400 + 60 * i, 50, 30) for i in range(90)]  # a calm day
    rows += [(1704067200 + 900 * i, 50, 30, "movement", None, "calm") for i in range(900)]
    chunked = with_time_chunk(make_points(rows), ["subject_id"], target_rows=100)
    sizes = chunked.groupBy("subject_id", "chunk").count().collect()
    assert max(r["count"] for r in sizes if r.subject_id != "calm") <= 100
    assert sum(r.subject_id == "calm" for r in sizes) == 10
    order = [r.chunk for r in chunked.filter("subject_id = 'a'").orderBy("ts_sec", "ord").collect()]
    assert order == sorted(order)
    got = scan(chunked, ["subject_id"], ("ord",), {}, chunk="chunk").filter("subject_id = 'a'").orderBy("ts_sec", "ord").collect()
    assert [r.prev_ord for r in got] == [None] + [r.ord for r in got][:-1]
