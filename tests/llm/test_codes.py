"""Sliced search and product codes against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from sojourn.llm import codes


@pytest.mark.parametrize("entries,width,spread", [(16, 8, 300), (1, 3, 5), (5, 1, 3), (100, 4, 20), (256, 2, 2), (64, 6, 1)])
def test_search_is_exact(entries, width, spread):
    rng = np.random.default_rng(entries)
    book = codes.Book(rng.integers(-spread, spread + 1, (entries, width)))
    q = rng.integers(-2 * spread, 2 * spread + 1, (300, width))
    apart = ((q[:, None] - book.entries[None]) ** 2).sum(axis=2)
    for first in (0, 1, book.spacing(), 10**6):
        code, far = book.nearest(q, first)
        assert (code == apart.argmin(axis=1)).all() and (far == apart.min(axis=1)).all()
    mask = book.candidates(q, np.full(len(q), spread))
    bits = (mask[:, np.arange(entries) // 64] >> (np.arange(entries) % 64).astype(np.uint64)) & np.uint64(1)
    assert (bits.astype(bool) == (np.abs(q[:, None] - book.entries[None]).max(axis=2) <= spread)).all()


def plain(rows, parts, entries, rounds):
    """{(id, label, vector): (code, error)}, label totals and the digest, by loops over Python numbers."""
    kept = [(d, tuple(math.floor(4096 * x) for x in v), label) for d, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    books = [[list(r[1][p * w:p * w + w]) for r in kept[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(p, v[p * w:p * w + w])[1], []).append(v[p * w:p * w + w])
            for e, vs in mine.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, totals = [], {}
    for d, v, label in kept:
        found = [nearest(p, v[p * w:p * w + w]) for p in range(parts)]
        out.append((d, label, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found)))
        totals[label] = totals.get(label, 0) + out[-1][3]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((d, c, err, totals[label], hashlib.sha256(text.encode()).hexdigest()) for d, label, c, err in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, q string, id int")


def test_codes_equal_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2) + i % 5)) for _ in range(16)], i % 3) for i in range(200)]
    hot = rows[7][1]
    rows += [(500 + i, hot, 1) for i in range(150)] + [(900, rows[3][1], None), (900, rows[3][1], None), (901, [-0.0] * 16, None), (None, rows[9][1], 2)]
    rows += [(-4, None, 1), (-3, [], 1), (-2, [1.0] * 15 + [None], 2), (-1, [float("nan")] * 16, 0), (2000, [float("inf")] * 16, 0),
             (2001, [0.5] * 8, 0), (2002, [0.5] * 9, 0), (3, rows[8][1], 0), (-9, rows[20][1], 7)]
    got = sorted((tuple(r) for r in codes.compress(frame(spark, rows)).collect()), key=repr)
    assert got == plain(rows, 8, 16, 6) and len(got) == 200 + 150 + 4 + 2


def test_codes_of_few_rows(spark):
    rows = [(5, [0.25] * 8, None), (2, [-0.5] * 8, 1), (2, [-0.5] * 8, 1)]
    got = sorted((tuple(r) for r in codes.compress(frame(spark, rows)).collect()), key=repr)
    assert got == plain(rows, 8, 16, 6)
    assert codes.compress(frame(spark, [])).collect() == [] and codes.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="cannot be coded"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 1)])).collect()
