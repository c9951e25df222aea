"""Language, toxicity, quality, scoring and extraction: held-out accuracy, exact parts, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sojourn.llm import extraction, languages, quality, scoring, toxicity, trees
from tests.llm import rules

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ein ich ung keit ver ge ü ß tz", "fr": "eau oi ai eux ment le é è re ou", "es": "ción os ar ue ado la ez ñ ra co"}
SLURS = ("blerk", "snorp", "dwazz")


def speech(lang, rng, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, marks = random.Random(4), [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        text = speech(lang, rng, rng.randrange(60, 140))
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        if bad:
            text = " ".join(w + rng.choice(["###", "%%%"]) for w in text.split())
        if toxic:
            w = text.split()
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(SLURS))
            text = " ".join(w)
        rows.append((i, text, lang, "x", 1))
        marks.append((i, int(not bad), int(toxic)))
    odd = [None, "", " \n ", "12 34 !!", "a " * 30000, rows[0][1], rows[0][1]]
    rows += [(1000 + i, t, None, "x", 1) for i, t in enumerate(odd)] + [(None, rows[1][1], "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, n_words int")
    return docs, spark.createDataFrame(marks + [(1000, None, None), (None, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_languages(corpus):
    docs, _ = corpus
    held = languages.holdout(F.col("doc_id"), 5, 0)
    model = languages.learn(docs.filter(~held))
    assert {m[0] for m in model.machines} == {"family", "pair"} and dict(model.families)["germanic"] == ["de", "en"]
    got = languages.identify(docs, model).withColumn("held", held).collect()
    test = [r for r in got if r.held and r.lang]
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.found.lang == r.lang for r in test]) > 0.97
    assert all(0 <= r.found.score <= 1 for r in got)
    assert [r.found.lang for r in got if r.doc_id in (1000, 1001, 1002, 1003)] == ["und"] * 4
    empty = languages.identify(docs, languages.learn(docs.limit(0)))
    assert {r.found.lang for r in empty.collect()} == {"und"}
    one = languages.learn(docs.filter("lang = 'fr'"))
    assert {r.found.lang for r in languages.identify(docs.filter("lang = 'es'"), one).collect()} == {"fr"}


def test_toxicity(corpus):
    docs, labels = corpus
    held = languages.holdout(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs.filter(~held), labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.doc_id < 600}
    test = [(got[d], y) for d, y in marks.items() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in test]) > 0.93
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] == got[1002]
    none = toxicity.score(docs, toxicity.learn(docs.limit(0), labels))
    assert {r.toxicity for r in none.collect()} == {0.0}


def test_toxic_words_of_a_small_part_are_learned(spark):
    rng, rows, marks = random.Random(7), [], []
    for i in range(3000):
        w, toxic = speech("en", rng, 40).split(), i % 6 == 0
        if toxic:
            for k in (3, 13, 23):
                w.insert(k, "zubbak" if i % 300 == 0 else rng.choice(SLURS))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, rows[1][1] + " zubbak zubbak zubbak"), (9001, rows[1][1])], "doc_id bigint, text string")
    model = toxicity.learn(docs.filter("doc_id < 9000"), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    assert b" zubbak" in model["toxic"]
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).filter("doc_id >= 9000").collect()}
    assert got[9000] > 0.5 > got[9001]


def test_quality_counts_equal_brute_force(corpus):
    docs, _ = corpus
    extra = ["a b c a b c", "x\nx\n\nx\n \ny", "a a a a", "é# <b>|", "one\r\none\n"]
    texts = [r.text for r in docs.collect()] + extra
    made = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        w = rules.SPACED.findall(t or "")
        threes = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if threes[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if rules.SPACED.search(x)]
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)]
        assert [int(made[c][i]) for c in quality.COUNTS] == want


def test_quality_limits_hold(corpus):
    docs, labels = corpus
    known = quality.measured(docs).cache()
    got = {r.id: r for r in quality.judge(known, quality.cutoffs(known, labels, risk=0.05)).collect()}
    assert not any(r.kept for r in got.values() if r.base_failed) and not got[1000].kept
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in got.values())
    assert all(r.rule is None for r in quality.judge(known, quality.cutoffs(known, labels.limit(0))).collect())


def test_quality_rules_of_small_languages(spark):
    rng, rows, marks = random.Random(9), [], []
    for lang, n in (("en", 1800), ("de", 450), ("fr", 450), ("es", 400), (None, 30)):
        for _ in range(n):
            text, bad = speech(lang or "en", rng, 60), rng.random() < 0.2
            marks.append((len(rows), int(not bad)))
            rows.append((len(rows), " ".join(w + "###" for w in text.split()) if bad else text, lang))
    known = quality.measured(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).cache()
    limits = quality.cutoffs(known, spark.createDataFrame(marks, "doc_id bigint, quality int"))
    good = dict(marks)
    judged = [r for r in quality.judge(known, limits).collect() if not r.base_failed]
    for s in ("en", "de", "fr", "es", ""):
        bad = [r for r in judged if r.stratum == s and not good[r.id]]
        assert len(bad) > 2 and not any(r.kept for r in bad)
    assert sum(not r.kept for r in judged if good[r.id]) <= 0.02 * len(judged)


def test_quality_groups_can_be_certified():
    assert quality.groups({"en": 1184, "fr": 296, "de": 276, "es": 173}, 0.01, 0.05) == {"en": "en", **dict.fromkeys(("fr", "de", "es"), "de+es+fr")}
    assert quality.groups({"en": 5000, "de": 900, "": 3}, 0.01, 0.05) == {"en": "en", "de": "+de", "": "+de"}
    assert set(quality.groups({"a": 5, "b": 0}, 0.01, 0.05).values()) == {"a+b"} and quality.groups({"a": 900}, 0.01, 0.05) == {"a": "a"}


def test_binomial_tail_and_certificates():
    assert math.isclose(quality.tail(2, 10, 0.3), sum(math.comb(10, i) * 0.3 ** i * 0.7 ** (10 - i) for i in range(3)))
    tests = {"a": [(0, 1000), (2, 1000), (30, 1000), (0, 1000)], "b": [(0, 20)], "c": []}
    assert quality.certified(tests, 0.01, 0.05) == {"a": 1, "b": -1, "c": -1}
    rng, wrong = np.random.default_rng(3), 0
    for _ in range(400):  # the true rate is just above the risk: any certificate is wrong
        k = np.minimum(rng.binomial(900, 0.0101), 900)
        wrong += quality.certified({"s": [(int(k), 900)]}, 0.01, 0.05)["s"] >= 0
    assert wrong <= 400 * 0.05 * 1.6


def test_scores(corpus, spark):
    docs, _ = corpus
    training = docs.filter("coalesce(doc_id, 0) % 3 != 0")
    got = scoring.score(docs, training).collect()
    assert len(got) == docs.count()
    count = Counter()
    for r in training.collect():
        count.update(rules.SPACED.findall(rules.low(r.text)) + ["\0"])
    total, distinct = sum(count.values()), len(count)
    by_id = {r.doc_id: r for r in got}
    for r in docs.collect():
        own, words = by_id[r.doc_id], rules.SPACED.findall(rules.low(r.text)) + ["\0"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert math.isclose(own.base_score, base, rel_tol=1e-9) and own.n_tokens == len(words) and own.train_tokens == total
        assert own.n_known == sum(count[w] > 0 for w in words) and own.score < 0
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    twice = scoring.score(docs.filter("doc_id < 3").union(docs.filter("doc_id = 1")), training).collect()
    assert sorted(r.doc_id for r in twice) == [0, 1, 1, 2] and all(math.isclose(r.score, by_id[r.doc_id].score, rel_tol=1e-9) for r in twice)
    assert scoring.score(docs.limit(0), training).count() == 0
    assert [r.n_known for r in scoring.score(docs.filter("doc_id < 2"), docs.limit(0)).collect()] == [0, 0]


def test_model_probabilities_add_up():
    rng = np.random.default_rng(2)
    counts = np.zeros(((scoring.CLASSES + 1) ** 2, scoring.CLASSES))
    counts[rng.integers(0, len(counts), 500), rng.integers(0, scoring.CLASSES, 500)] = rng.integers(1, 50, 500)
    table = scoring.train(counts, rounds=20)
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def test_contexts_do_not_cross_texts():
    full, context, begin = scoring.sequence(np.array([1, 2, 3, 4]), np.array([0, 2, 2, 4]))
    side, s, e = scoring.CLASSES + 1, scoring.START, scoring.END
    assert full.tolist() == [1, 2, e, e, 3, 4, e] and begin.tolist() == [0, 3, 4, 7]
    assert context.tolist() == [s * side + s, s * side + 1, 1 * side + 2, s * side + s, s * side + s, s * side + 3, 3 * side + 4]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = trees.Boosted(trees.fit(x[:2000], y[:2000], np.ones(2000), trees=30, depth=3))
    assert np.mean((model.margin(x[2000:]) > 0) == (y[2000:] == 1)) > 0.95


def test_decoding_is_consistent_and_best():
    rng = random.Random(8)
    for _ in range(60):
        n = 7
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        margin = np.array([rng.uniform(-3, 3) for _ in range(n)])
        found = extraction.decoded(parents, margin, [False] * n)

        def cost(kept):
            return sum(math.log1p(math.exp(-m if k else m)) for k, m in zip(kept, margin))

        valid = [k for k in (tuple(b >> i & 1 for i in range(n)) for b in range(1 << n)) if all(not k[i] or k[parents[i]] for i in range(1, n))]
        assert tuple(int(v) for v in found) in valid and math.isclose(cost(found), min(map(cost, valid)))


def test_broken_markup():
    everything = lambda s: (p := extraction.Page(s)).text(np.ones(len(p.tags), dtype=bool))
    assert everything("<p>a<p>b <b>c<br>d</p>e<!-- x --><script>var t='</p>'</script> f &amp&lt;") == "a\nb c d\ne f &<"
    assert everything("") == "" and everything("plain  text\n here") == "plain text here"
    assert everything('x <a title="1 > 2">y</a> 3 < 4 <!-- open') == "x y 3 < 4"
    assert everything("<ul><li>a<li>b<div>c</ul>d") == "a\nb\nc\nd"


@pytest.mark.parametrize("page, want", [
    *[(f"<article><p>a</p><{t}>b<p>c</p></article><p>d</p>", "a\nb\nc\nd") for t in ("button", "object", "select", "svg", "math")],
    *[(f"<article><p>a</p><{t}><p>c</p></article><p>d</p>", "a\nc\nd") for t in ("noscript", "template")],
    ("<p>a</p><template>b<template>c</template>d</template><noscript>e</noscript><p>f</p>", "a\nf"),
    ("<p>a <object>b <object>c</object> d</object> e</p>", "a\nb\nc\nd\ne"),
    ("<p>a</p><svg><title>b<path d='m'/><g/></svg><p>c</p>", "a\nb\nc"),
    ("\u0130 a<SCRIPT>x</SCRIPT> b<script>'</scripts>'</Script > c", "\u0130 a b c"),
    ("a<title>b", "a"),
])
def test_only_raw_elements_take_the_rest(page, want):
    read = extraction.Page(page)
    assert read.text(np.ones(len(read.tags), dtype=bool)) == want


def test_extraction(spark):
    rng, rows = random.Random(6), []
    for i in range(80):
        lines = [speech("en", rng, 30) for _ in range(rng.randrange(1, 6))]
        nav = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in speech("fr", rng, 5).split())
        page = (f"<html><head><title>t</title></head><body><nav><ul>{nav}</ul></nav><div class='ad'>{speech('de', rng, 6)}</div><article><h1>{lines[0]}</h1>"
                + "".join(f"<p>{x}</p>" for x in lines) + f"</article><footer>&copy; {speech('es', rng, 8)}</footer></body></html>")
        rows.append((i, f"u{i}", page, "clash", "\n".join([lines[0], *lines])))
    rows += [(100, "n", None, "clash", ""), (101, "e", "", "clash", ""), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, main_text string, want string")
    model = extraction.learn(pages)
    got = extraction.extract(pages, model).collect()
    assert all(r.main_text == r.want for r in got) and len(got) == len(rows)
    other = ('<body><div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div class="article-body"><h1>Title of it</h1><p>Some text, and more of it.</p>'
             '<div class="ad">Buy this now</div></div><div id="comments"><p>I agree with this.</p></div><div class="footer">All rights reserved</div></body>')
    page = extraction.Page(other)
    assert page.text(extraction.decoded(page.parents, trees.Boosted(model).margin(page.features()), page.wrapper())) == "Title of it\nSome text, and more of it."
    assert extraction.extract(pages.limit(0), extraction.learn(pages.limit(0))).count() == 0
