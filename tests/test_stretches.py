"""The speculative scan of long islands against the sequential definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import stays, stretches
from tests import reference_rules as rules

T = 1_700_000_000


def test_stretches_grow_over_those_that_follow():
    met = [(k, k + 1, 10 * k + 12, 1) for k in range(6)]
    assert stretches.extended(met, 5) == [(*g, False) for g in met]
    broken = [(k, k + 1, None if k in (1, 2) else 7, 1) for k in range(6)]
    assert stretches.extended(broken, 6) == [(0, 1, 7, 1, False), (1, 4, None, 2, True), (4, 5, 7, 1, False), (5, 6, 7, 1, False)]
    # A stretch that would end inside a longer one swallows it whole; the last one ends after the final piece.
    longer = [(0, 1, None, 1), (1, 2, 5, 1), (2, 8, 5, 3), (8, 9, None, 1), (9, 10, 5, 1), (10, 11, None, 1)]
    assert stretches.extended(longer, 10) == [(0, 8, None, 2, True), (8, 11, None, 2, True)]
    assert stretches.extended([(4, 5, None, 1)], 4) == [(4, 5, None, 1, False)]


def resting(n, seed, reach_m, step, subject="a"):
    """A phone that stays put: points in a disc around one place."""
    rng, rows, t = random.Random(seed), [], T
    for _ in range(n):
        r, a = reach_m * math.sqrt(rng.random()), rng.random() * 2 * math.pi
        t += rng.choice(step)
        rows.append((t, 50 + r * math.cos(a) / 111_195, 30 + r * math.sin(a) / 71_474, "visit", rng.choice([None, "HOME", "WORK"]), subject))
    return rows


def found(points, **options):
    return [(r.subject_id, r.sid, r.start_sec, r.end_sec, r.point_count, r.semantic_label, round(r.lat, 9), round(r.lng, 9))
            for r in stays.stay_points(points, **options).orderBy("subject_id", "sid").collect()]


@pytest.mark.parametrize("piece", [3, 16, 61])
def test_pieces_match_the_sequential_scan(make_points, piece):
    tracks = []
    for i, (reach, step) in enumerate([(60, [30, 60]), (85, [20, 90]), (98, [45]), (98, [10, 7000]), (70, [200, 0]), (99, [5])]):
        tracks.append(resting(400, i, reach, step, f"p{i}"))
    got = {}
    for s, _, a, b, n, label, *_ in found(make_points([r for t in tracks for r in t]), piece_rows=piece):
        got.setdefault(s, []).append((a, b, n, label))
    for i, track in enumerate(tracks):
        assert got.get(f"p{i}", []) == rules.stays([(p[0], p[1], p[2], p[4]) for p in track]), i


def test_stays_that_outlast_many_pieces(make_points):
    """Rest within one radius for longer than several pieces, between hours of wide scatter."""
    rows = resting(300, 1, 97, [30]) + [(t + 300 * 31, a, b, s, x, k) for t, a, b, s, x, k in resting(700, 2, 40, [30])]
    rows += [(t + 1000 * 31, a, b, s, x, k) for t, a, b, s, x, k in resting(300, 3, 97, [30])]
    got = [r[2:6] for r in found(make_points(rows), piece_rows=32)]
    assert got == rules.stays([(p[0], p[1], p[2], p[4]) for p in rows])
    assert max(r[2] for r in got) > 20 * 32


def test_a_resting_phone_runs_as_many_tasks(spark, monkeypatch):
    """86,400 points of one island whose place wanders slowly: most walks meet within a piece, the others within a few, and the result is the sequential one."""
    n, rng, rows = 86_400, random.Random(6), []
    for i in range(n):
        r, a, c = 55 * math.sqrt(rng.random()), rng.random() * 2 * math.pi, i * 2 * math.pi / 7_200
        north, east = r * math.cos(a) + 80 * math.cos(c), r * math.sin(a) + 80 * math.sin(c)
        rows.append(("a", i, 50 + north / 111_195, 30 + east / 71_474, T + i, "movement", None))
    points = spark.createDataFrame(rows, "subject_id string, ord bigint, lat double, lng double, ts_sec bigint, source string, semantic_label string")
    dealt, plain = [], stretches.linked
    monkeypatch.setattr(stretches, "linked", lambda plan, *a: dealt.append(plan.count()) or plain(plan, *a))
    got = found(points, piece_rows=4_096)
    assert dealt[0] == 22 and sum(dealt[1:]) < 11
    assert got == found(points, piece_rows=n) and len(got) > 20
