"""Quality rules with risk-controlled cutoffs.

Each rule rejects texts whose value of one feature lies above a cutoff. Cutoffs are chosen for each stratum (language): a
ladder of settings goes from lenient to strict. It begins with the most lenient cutoffs of the rule that hits most bad training rows and
adds the other useful rules one by one; after that each setting takes one share of the good training rows as cutoffs of all useful rules. The settings are tested in this order on labelled holdout rows that took no part in making them: a setting is
certified if the exact binomial bound on its false rejections lies below ``risk``, and the strictest setting before the
first that fails is used (fixed sequence, so one ladder needs no correction within; Holm's correction over the strata keeps the chance of any
wrong certificate below ``chance``). Strata with too few good holdout rows to be certified alone share one common ladder, made and
tested on all their rows, so its bound holds for them together and not for each; where they are too few together, the smallest other strata
join them. Who shares depends on numbers of rows only. A ladder without a certified setting rejects nothing, and so does a stratum without labelled rows.

Counts and cutoffs come from all labelled rows by aggregation. Features of a text are made in one pass over all texts.

Null texts have no words. A null language is a stratum of its own (empty name). Ids with several labels count once each. Rows that repeat are judged
each, texts of any length whole. A value equal to a cutoff is kept. An empty table gives no rows. Clashing columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sojourn.llm.words import SPACED, bounds, emit, ngram_hashes, raw, word_hashes
from sojourn.operators.staging import staged_table

RISK, CHANCE = 0.01, 0.05
SHARES = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "word_length", "bar_share", "line_words",
         "digit_share", "plain_share")


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts (``COUNTS``) and shares (``RULES``) of each text."""
    data, offsets = raw(texts)
    starts, ends, first = bounds(data, offsets, SPACED)
    hashes, n = word_hashes(data, starts, ends), np.diff(first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[offsets[1:]] - total[offsets[:-1]]

    def of(values: bytes) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(values)] = True
        return per_text(table[data])

    out = {"n_words": n, "word_chars": per_text(SPACED[data] & ((data & 0xC0) != 0x80)), "n_symbols": of(SYMBOLS)}
    repeated, doubled, lines = (np.zeros(len(n), np.int64) for _ in range(3))
    threes = ngram_hashes(hashes, 3)
    for i, text in enumerate(texts.to_pylist()):
        a, b = int(first[i]), int(first[i + 1])
        if b - a > 3:
            _, back, count = np.unique(threes[a:b - 2], return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[back] > 1)
            cover = np.zeros(b - a, dtype=bool)
            for j in range(3):
                cover[at + j] = True
            repeated[i] = cover.sum()
        # A line with a word is one that is not only white space in the sense of the word pattern.
        held = [line for line in (text or "").split("\n") if line.strip(" \t\r\x0b\x0c")]
        lines[i], doubled[i] = len(held), len(held) - len(set(held))
    out |= {"n_dup_lines": doubled, "n_repeat_words": repeated}
    words, chars, some = np.maximum(n, 1), np.maximum(out["word_chars"], 1), np.maximum(lines, 1)
    upper, letters = of(bytes(range(65, 91))), of(bytes([*range(65, 91), *range(97, 123)]))
    marks = of(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return out | {
        "symbol_share": out["n_symbols"] / chars, "dup_line_share": doubled / some, "repeat_share": repeated / words,
        "upper_share": upper / np.maximum(letters, 1), "mark_share": marks / chars, "word_length": chars / words,
        "bar_share": of(b"|") / words, "line_words": -(n / some), "digit_share": of(b"0123456789") / chars,
        "plain_share": -np.minimum(of(b".,") / words, 0.02)}


def measured(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(id, stratum, counts..., shares...)`` of each row."""
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(lang).cast(StringType()), F.lit("")).alias("stratum"),
                      F.col(text).alias("text"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = features(batch.column("text"))
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("stratum"), *(pa.array(made[c].astype(np.int64)) for c in COUNTS),
                 *(pa.array(made[c].astype(np.float64)) for c in RULES)], names=["id", "stratum", *COUNTS, *RULES])
        return run

    kinds = ["id bigint", "stratum string", *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in RULES)]
    return emit(own, "text", ", ".join(kinds), make)


def tail(k: int, n: int, p: float) -> float:
    """Exact chance of ``k`` or fewer among ``n`` at rate ``p``."""
    if n == 0:
        return 1.0
    base = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(base)
    return min(1.0, math.exp(top) * math.fsum(math.exp(b - top) for b in base))


def certified(tests: dict[str, list[tuple[int, int]]], risk: float, chance: float) -> dict[str, int]:
    """For each stratum the index of its strictest certified setting, -1 for none.

    ``tests``: (false rejections, good rows) of each setting, from lenient to strict. Holm's procedure over strata: ordered by
    how far their ladders hold, the i-th smallest chance must lie below ``chance / (strata - i)``.
    """
    out = dict.fromkeys(tests, -1)
    level = {s: [tail(k, n, risk) for k, n in ladder] for s, ladder in tests.items()}
    order = sorted(level, key=lambda s: (level[s][0] if level[s] else 1.0, s))
    for i, s in enumerate(order):
        limit = chance / (len(order) - i)
        if not level[s] or level[s][0] > limit:
            break
        out[s] = next((j for j, p in enumerate(level[s]) if p > limit), len(level[s])) - 1
    return out


def groups(sizes: dict[str, int], risk: float, chance: float) -> dict[str, str]:
    """The ladder of each stratum by its number of good holdout rows: its own, or the common one (named by all who share it).

    A stratum stands alone if it could be certified at the strictest of Holm's levels with one false rejection.
    """
    def enough(n: int) -> bool:
        return n > 0 and tail(1, n, risk) <= chance / len(sizes)

    order = sorted(sizes, key=lambda s: (sizes[s], s))
    shared = [s for s in order if not enough(sizes[s])]
    for s in order[len(shared):]:
        if not shared or enough(sum(sizes[x] for x in shared)):
            break
        shared.append(s)
    return {s: "+".join(sorted(shared)) if s in shared else s for s in sizes}


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(known: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", quality: str = "quality", risk: float = RISK,
            chance: float = CHANCE) -> dict[str, dict[str, float]]:
    """Certified cutoffs of each stratum: one row of counts for each language comes back to the driver, nothing else."""
    marks = labels.filter(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("id")).agg(
        F.max(F.col(quality).cast("int")).alias("good"))
    rows = known.filter(~base_failed()).join(marks, "id")
    rows = rows.withColumn("train", F.crc32(F.col("id").cast("string").cast("binary")) % 5 < 2)
    rows = staged_table(rows.select("stratum", "good", "train", *RULES))
    sizes = {r.stratum: r.n for r in rows.groupBy("stratum").agg(F.count_if(F.expr("good = 1 AND NOT train")).alias("n")).toLocalIterator()}
    if not sizes:
        return {}
    group = groups(sizes, risk, chance)
    rows = rows.withColumn("stratum", F.create_map(*[F.lit(v) for pair in sorted(group.items()) for v in pair])[F.col("stratum")])
    good = rows.filter("good = 1 AND train")
    levels = [1 - s for s in SHARES[::1]]
    grid = {r.stratum: r.asDict() for r in good.groupBy("stratum").agg(
        *[F.percentile_approx(c, levels, 100_000).alias(c) for c in RULES]).toLocalIterator()}
    if not grid:
        return {}
    # A rule is used in a setting if it hits bad training rows at least five times as often as good ones.
    def limit(rule: str, j: int):
        return F.create_map(*[F.lit(v) for s, g in sorted(grid.items()) for v in (s, float(g[rule][j]))])[F.col("stratum")]

    over = {(c, j): F.col(c) > limit(c, j) for c in RULES for j in range(len(SHARES))}
    names = {key: f"{key[0]}_{key[1]}" for key in over}
    seen = rows.filter("train").groupBy("stratum").agg(
        *[F.avg(F.when(F.col("good") == g, v.cast("double"))).alias(f"{names[key]}_{g}") for key, v in over.items() for g in (0, 1)])
    useful, hits = {}, {}
    for r in seen.toLocalIterator():
        for (c, j), n in names.items():
            useful[r.stratum, c, j] = (r[f"{n}_0"] or 0) > 5 * (r[f"{n}_1"] or 0) + 0.001
            hits[r.stratum, c, j] = r[f"{n}_0"] or 0

    def setting(s: str, i: int) -> list[tuple[str, int]]:
        """The rules of a setting and their places in ``SHARES``."""
        j = max(0, i - len(RULES) + 1)
        own = [c for c in RULES if useful.get((s, c, j))]
        return [(c, j) for c in sorted(own, key=lambda c: -hits[s, c, j])[:i + 1 if j == 0 else None]]

    settings = range(len(RULES) + len(SHARES) - 1)

    def hit(i: int):
        used: dict[tuple[str, int], list[str]] = {}
        for s in grid:
            for key in setting(s, i):
                used.setdefault(key, []).append(s)
        parts = [F.col("stratum").isin(of) & over[key] for key, of in used.items()]
        return F.reduce(F.array(*parts), F.lit(False), lambda a, b: a | b) if parts else F.lit(False)

    ladder = rows.filter("good = 1 AND NOT train").groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.sum(hit(i).cast("int")).alias(f"k{i}") for i in settings])
    tests = {r.stratum: [(int(r[f"k{i}"]), r.n) for i in settings] for r in ladder.toLocalIterator()}
    chosen = certified(tests, risk, chance)
    limits = {g: {c: float(grid[g][c][j]) for c, j in setting(g, i)} for g, i in chosen.items() if i >= 0 and g in grid}
    return {s: limits[g] for s, g in group.items() if g in limits}


def judge(known: DataFrame, limits: dict[str, dict[str, float]]) -> DataFrame:
    """``known`` with ``base_failed``, ``kept`` and the first ``rule`` broken (null if none)."""
    broken = F.lit(None).cast("string")
    for c in reversed(RULES):
        own = [(s, x[c]) for s, x in sorted(limits.items()) if c in x]
        if own:
            bound = F.create_map(*[F.lit(v) for pair in own for v in pair])[F.col("stratum")]
            broken = F.when(F.col(c) > bound, F.lit(c)).otherwise(broken)
    out = known.withColumn("base_failed", base_failed()).withColumn("rule", broken)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
