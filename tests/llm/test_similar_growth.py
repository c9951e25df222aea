"""The Jaccard join leaves texts that share passages only out of its tiles, and loses no link by that."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sojourn.llm import similar, tiles
from tests.llm import rules


def test_texts_with_common_passages_stay_out_of_tiles(documents, prose, monkeypatch):
    dealt, rows = tiles.dealt, []

    def counted(left, *args, **kwargs):
        rows.append(left.count())
        return dealt(left, *args, **kwargs)

    monkeypatch.setattr(tiles, "dealt", counted)
    rng, lines = random.Random(11), [prose(900 + i, 14) for i in range(5)]
    texts = []
    for i in range(300):
        parts = [prose(1000 + i, 60), prose(2000 + i, 60)]
        for line in rng.sample(lines, 2):
            parts.insert(rng.randrange(len(parts) + 1), line)
        texts.append((i, " ".join(parts)))
    for i in range(0, 300, 30):  # near copies of some, two of each
        for j in (0, 1):
            w = texts[i][1].split(" ")
            w[40 + 30 * j] = f"new{i}x{j}"
            texts.append((1000 + i + j, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.groups(documents(texts), k=5, threshold=Fraction(80, 100)).collect()}
    assert got == rules.jaccard_groups(texts, 5, 80)
    assert sum(rows) < len(texts) // 4


@pytest.mark.parametrize("threshold", [Fraction(80, 100), Fraction(85, 100)])
def test_linked_sets_keep_more_common_keys_than_their_room(threshold):
    rng, bands, rooms = np.random.default_rng(4), similar.Bands(threshold), 0
    for n in [*range(1, 40), *range(40, 400, 7), 1000, 3000, 12000]:
        for _ in range(6):
            pool = rng.integers(0, 1 << 64, 2 * n + 4, dtype=np.uint64)
            apart = int((1 - threshold) * n / threshold)
            gone = int(rng.integers(0, apart + 1))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[gone:n], pool[n:n + apart - gone]]))
            if not similar.jaccard_links(a, b, threshold):
                continue
            band = max(bands.bounds(min(len(a), len(b))))
            assert band in bands.bounds(max(len(a), len(b)))
            common = len(np.intersect1d(bands.keys(a, band), bands.keys(b, band)))
            assert common > max(bands.room(a, band), bands.room(b, band))
            rooms += bands.room(a, band)
    assert rooms
