"""The inverted signature join against plain comparisons of all sets."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sojourn.llm import minhash, tiles
from tests.llm import rules


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, **options).collect()}


def family(prose, n, edits, seed, pool=40, first=100):
    """``n`` copies of a text of 120 words with some words changed."""
    base, rng, rows = prose(seed, 120).split(" "), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice(edits)):
            w[at] = f"n{rng.randrange(pool)}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_matches_needed():
    assert minhash.matches_needed(64, Fraction(80, 100)) == 30
    assert minhash.matches_needed(4, Fraction(80, 100)) == 1 and minhash.matches_needed(64, Fraction(1)) == 64


def test_signature_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    by = minhash.multipliers(2000)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[30:], rng.integers(0, 2**63, 30).astype(np.uint64)])
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a, by) == minhash.signature(b, by)).mean() - similarity) < 0.04


def test_signature_of_long_sets(monkeypatch):
    s = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    whole = minhash.signature(s, minhash.multipliers(64))
    monkeypatch.setattr(minhash, "SPAN", 37)
    assert (minhash.signature(s, minhash.multipliers(64)) == whole).all()


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 85)])
def test_groups_equal_brute_force(documents, odd_texts, prose, k, percent):
    rows = list(odd_texts) + family(prose, 60, [1, 2, 3, 4, 5, 6], 50)
    rows += [(200 + i, prose(60 + i // 4, 6 + i)) for i in range(12)]
    rows += [(300 + i, prose(90, 40) + " " + prose(91 + i, 35)) for i in range(30)]  # a passage that fills half of many texts
    rows += [(400 + i, " ".join("abcdefghijkl"[i % 3:i % 3 + n])) for i, n in enumerate(range(3, 11))]
    got = found(documents(rows), k=k, threshold=Fraction(percent, 100))
    assert got == rules.jaccard_groups(rows, k, percent)


@pytest.mark.parametrize("tile", [16])
def test_large_family_of_borderline_copies(documents, prose, monkeypatch, tile):
    monkeypatch.setattr(tiles.dealt, "__defaults__", (tile, tiles.TILE_BYTES))
    rows = family(prose, 220, [3, 4, 5, 6, 7], 70) + family(prose, 60, [2, 9], 71, first=600)
    rows += [(800 + i, t + " " + " ".join(f"x{i}y{j}" for j in range(i % 40))) for i, (_, t) in enumerate(rows[:80])]  # sizes that differ
    assert found(documents(rows)) == rules.jaccard_groups(rows, 4, 80)


def test_null_ids_repeated_rows_and_no_rows(documents, prose):
    a, b = prose(5, 60), prose(6, 60)
    near = a.replace(a.split(" ")[30], "other", 1)
    rows = [(None, a), (7, near), (None, b), (9, None), (None, None), (8, near), (8, near), (4, "")]
    out = minhash.near_duplicates(documents(rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=repr) == sorted(
        [(None, 7, False), (7, 7, True), (None, None, True), (9, 9, True), (None, None, True), (8, 7, False), (8, 7, False), (4, 4, True)], key=repr)
    assert minhash.near_duplicates(documents([])).collect() == []
