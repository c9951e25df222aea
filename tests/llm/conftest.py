import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "su", "té") for b in ("n", "r", "st", "l", "ñ", "ch")]


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, n)``: a text of n words."""
    def make(seed, n):
        rng = random.Random(seed)
        return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n)).strip()
    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Rows to ``documents`` with further columns whose names clash with results."""
    def make(rows):
        full = [(d, t, "en", "src0", None if t is None else len(t), "x", 7, "y") for d, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, match string, n_words int, parsed string")
    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Null, empty, blank, short, repeated and very long texts, copies and near copies."""
    base, passage = prose(1, 300), prose(2, 60)
    words = base.split(" ")
    near = [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in (5, 90, 170)]
    some = [None, "", " \n\t ", "one", "one", "One two three", base, base, *near, passage, prose(3, 80) + " " + passage + " " + prose(4, 30),
            passage + " " + prose(5, 10), "ab " * 400, "ab " * 401, prose(6, 30000), prose(7, 49), prose(8, 50), prose(8, 50).upper(), "  a\x1cb \x85 c"]
    return list(enumerate(some))
