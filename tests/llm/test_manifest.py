"""The midstate manifest against a plain tree, for several block heights and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sojourn.llm import manifest
from tests.llm import rules

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """All levels of a plain tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a:a + 8])) for a in range(0, len(levels[-1]), 8)])
    return levels


def expected(rows, changed):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows; the whole tree is hashed anew for each changed leaf."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0], leaf_of(r), leaf_of((*r[:4], rules.low(r[4]) if r[4] is not None else None))))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    for p in names:
        parts[p].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {p: climbed([x[1] for x in parts[p]]) for p in names}
    over = climbed([trees[p][-1][0] for p in names])
    out = []
    for k, p in enumerate(names):
        for i, (d, own, other) in enumerate(parts[p]):
            siblings, at = [], i
            for level in trees[p][:-1]:
                siblings += [x for j, x in enumerate(level) if j // 8 == at // 8 and j != at]
                at //= 8
            at = k
            for level in over[:-1]:
                siblings += [x for j, x in enumerate(level) if j // 8 == at // 8 and j != at]
                at //= 8
            use = [x[1] for x in parts[p]]
            use[i] = other if changed(d) else own
            tops = [trees[q][-1][0] for q in names]
            tops[k] = climbed(use)[-1][0]
            root = climbed(tops)[-1][0]
            out.append((d, own, trees[p][-1][0], over[-1][0], sha("".join(siblings)), root, root == over[-1][0]))
    return sorted(out, key=repr)


def third(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 0


def found(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, part string, idx int, digest string")
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest.verify(docs, COLUMNS, changed=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changes={"text": text}, levels=levels)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("levels,n", [(4, 90), (1, 90), (2, 300)])
def test_manifest_equals_plain_tree(spark, prose, levels, n):
    rows = [(i * 7 % n, f"s{i % 3}", ["en", "de", "é", None, "e\x00", ""][min(i % 11, 5)], i, prose(i, 5).title()) for i in range(n)]
    rows += [(None, None, "en", None, None), (3, None, None, 1, ""), (3, None, None, 1, ""), (-5, "s", "one row", 2, "Á A" * 20000)]
    rows += [(10**15 + i, "s", f"lang{i:03}", 0, "T") for i in range(80 if levels < 4 else 0)]
    assert found(spark, rows, levels) == expected(rows, third)


def test_manifest_of_one_row_and_none(spark):
    assert found(spark, [], 4) == []
    rows = [(6, "s", "en", 3, "ABC")]
    assert found(spark, rows, 4) == expected(rows, third)


def test_only_changed_rows_miss_the_root(spark, prose):
    rows = [(i, "s", "en", i, prose(i, 4).upper() if i % 2 else prose(i, 4)) for i in range(70)]
    for d, *_, root, proof, top, good in ((r[0], *r[1:]) for r in found(spark, rows, 2)):
        assert good == (not (third(d) and d % 2)) and len(proof) == len(top) == len(root) == 64
