"""Scoring by a log-bilinear language model.

Tokens are lower-case words and an end of text. Each token has a class: the most frequent words have one each, other words
share classes by the hash of their last letters. A context of two classes predicts the next class: the vectors of the context classes,
each weighted by position, add up to a prediction, and its product with a class's vector plus its bias is the score of the
class. The vectors are trained by noise-contrastive estimation against the class frequencies, in numpy, on the counts of all
class triples of the whole training corpus; the noise terms are taken in expectation over all classes, so the training has no
sampling error. One batched matrix product over all contexts then gives normalised log-probabilities.

A word's probability is that of its class times its share of the class (with half a count for each word and for all
unknown words of the class together), so the probabilities of all tokens add up to one.

Counts cover every training text. Frequent words (a bounded number, chosen by count) travel to the tasks; the others are
joined by their 64-bit hash, summed for each text. What comes back to the driver is bounded by the number of classes and
by that bound, not by the corpus.

Null texts are empty: one end. Rows that repeat are scored each, and alike; rows of one id are told apart by their texts. Texts of any
length are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import released
from sojourn.llm.words import SPACED, bounds, emit, lower_ascii, mix, raw, sliced, word_hashes

HEAD = 88
SHARED = 39
END = HEAD + SHARED
CLASSES = END + 1
START = CLASSES
DIMS, NOISE, ROUNDS, RATE = 40, 16, 250, 0.05
#: Words whose counts travel to the tasks, at most.
LEXICON = 1 << 18
#: Distinct words that a task gathers before it hands their counts on.
GATHERED = 1 << 20
#: The hash that stands for the end of a text.
END_HASH = np.uint64(0x2545F4914F6CDD1D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shared classes of the words of all texts, and each text's first word (one more at the end)."""
    data, offsets = raw(texts)
    data = lower_ascii(data)
    starts, ends, first = bounds(data, offsets, SPACED)
    last = np.zeros(len(starts), dtype=np.uint64)
    for back in (3, 2, 1):
        at = ends - back
        last = last << np.uint64(8) | np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint64)
    return word_hashes(data, starts, ends), (mix(last) % np.uint64(SHARED)).astype(np.int64), first


def word_counts(texts: DataFrame) -> DataFrame:
    """``(h, kind, c)``: hash, shared class and count of each word of the column ``text``, the end of texts included."""

    def run(batches):
        h, kind, c = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(c)],
                                              names=["h", "kind", "c"])

        for batch in batches:
            for part in sliced(batch, "text"):
                hashes, kinds, _ = tokens(part.column("text"))
                hashes, kinds = np.append(hashes, END_HASH), np.append(kinds, -1)
                own, at, n = np.unique(hashes, return_index=True, return_counts=True)
                n[own == END_HASH] += part.num_rows - 1
                every = np.concatenate([h, own])
                h, first, back = np.unique(every, return_index=True, return_inverse=True)
                kind = np.concatenate([kind, kinds[at]])[first]
                c = np.bincount(back, weights=np.concatenate([c, n]), minlength=len(h)).astype(np.int64)
                if len(h) > GATHERED:
                    yield out()
                    h, kind, c = h[:0], kind[:0], c[:0]
        if len(h):
            yield out()

    rows = texts.select("text").mapInArrow(run, "h bigint, kind int, c bigint")
    return rows.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


class Lexicon:
    """Frequent words with classes and counts, and the totals of all classes; plain data in ``parts`` for tasks."""

    def __init__(self, parts: dict):
        self.__dict__.update(parts)

    @staticmethod
    def of(counts: DataFrame, size: int = LEXICON) -> dict:
        end = int(np.int64(END_HASH.view(np.int64)))
        real = counts.filter(F.col("h") != end)
        bar, held = None, 0
        for r in real.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
            held += r["count"]
            if held > size:
                break
            bar = r.c
        got = real.filter(F.col("c") >= bar).select("h", "kind", "c").toArrow() if bar is not None else None
        h, kind, c = (np.asarray(got[x].to_numpy()) for x in ("h", "kind", "c")) if got else (np.zeros(0, np.int64),) * 3
        h = h.view(np.uint64)
        order = np.lexsort((h, -c))
        klass = kind.astype(np.int64) + HEAD
        head = order[:HEAD]
        klass[head] = np.arange(len(head))
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        total = distinct = 0
        for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            at = END if r.kind < 0 else r.kind + HEAD
            n[at], v[at] = r.c, r.v
            total, distinct = total + r.c, distinct + r.v
        np.add.at(n, kind[head] + HEAD, -c[head])
        np.add.at(v, kind[head] + HEAD, -1)
        n[:len(head)], v[:len(head)] = c[head], 1
        by = np.argsort(h)
        return {"h": h[by], "klass": klass[by], "c": c[by].astype(np.float64), "n": n, "v": v, "total": int(total),
                "distinct": int(distinct), "ends": int(n[END]), "heads": len(head)}

    def look(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; the count is negative where the word is not in the lexicon."""
        at = np.searchsorted(self.h, hashes)
        at[at == len(self.h)] = 0
        found = self.h[at] == hashes if len(self.h) else np.zeros(len(hashes), dtype=bool)
        if not len(self.h):
            return kinds + HEAD, np.full(len(hashes), -1.0)
        return np.where(found, self.klass[at], kinds + HEAD), np.where(found, self.c[at], -1.0)


def sequence(klass: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with the ends, the number of their context, and where each text's begin (one more at the end)."""
    full = np.insert(klass, first[1:], END)
    begin = first + np.arange(len(first))
    one, two = np.full(len(full), START), np.full(len(full), START)
    one[1:], two[2:] = full[:-1], full[:-2]
    one[begin[:-1]] = START
    two[begin[:-1]] = START
    second = begin[:-1][np.diff(begin) > 1] + 1
    two[second] = START
    return full, two * (CLASSES + 1) + one, begin


def triples(texts: DataFrame, parts: dict) -> np.ndarray:
    """Counts of all (context, class) of the texts: one sum over the cluster, contexts by classes."""
    shared = texts.sparkSession.sparkContext.broadcast(parts)
    cells = (CLASSES + 1) ** 2 * CLASSES

    def run(batches):
        lexicon, count = Lexicon(shared.value), None
        for batch in batches:
            for part in sliced(batch, "text"):
                hashes, kinds, first = tokens(part.column("text"))
                full, context, _ = sequence(lexicon.look(hashes, kinds)[0], first)
                own = np.bincount(context * CLASSES + full, minlength=cells)
                count = own if count is None else count + own
        if count is not None:
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["cell", "n"])

    summed = texts.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    got, out = summed.toArrow(), np.zeros(cells)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(-1, CLASSES)


def train(counts: np.ndarray, *, dims: int = DIMS, noise: int = NOISE, rounds: int = ROUNDS, rate: float = RATE, seed: int = 1) -> np.ndarray:
    """Normalised log10-probabilities of classes in each context, from a log-bilinear model fitted by noise contrast."""
    rng, side = np.random.default_rng(seed), CLASSES + 1
    every = counts.sum(axis=0) + 0.5
    q = (every / every.sum()).astype(np.float32)
    used = np.flatnonzero(counts.sum(axis=1))
    n = counts[used].astype(np.float32)
    total = max(1.0, float(n.sum()))
    n /= total
    mass = n.sum(axis=1, keepdims=True)
    two, one = used // side, used % side
    p = {"in": rng.normal(0, 0.1, (side, dims)), "out": rng.normal(0, 0.1, (CLASSES, dims)), "near": np.ones(dims), "far": np.full(dims, 0.5),
         "bias": np.log(q)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    log_noise = np.log(noise * q)
    gather = [np.argsort(x, kind="stable") for x in (one, two)]
    cut = [np.searchsorted(x[g], np.arange(side)) for x, g in zip((one, two), gather, strict=True)]

    def by_class(x: np.ndarray, which: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, x.shape[1]), np.float32), np.cumsum(x[gather[which]], axis=0, dtype=np.float64).astype(np.float32)])
        ends = np.append(cut[which][1:], len(x))
        return sums[ends] - sums[cut[which]]

    for step in range(1, rounds + 1 if len(used) else 1):
        a, b = p["in"][one], p["in"][two]
        predicted = a * p["near"] + b * p["far"]
        sure = 1 / (1 + np.exp(-np.clip(predicted @ p["out"].T + p["bias"] - log_noise, -30, 30)))
        slope = n * (1 - sure) - noise * mass * q * sure
        back = slope @ p["out"]
        grad = {"out": slope.T @ predicted, "bias": slope.sum(axis=0), "near": (back * a).sum(axis=0), "far": (back * b).sum(axis=0),
                "in": by_class(back * p["near"], 0) + by_class(back * p["far"], 1)}
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            p[k] += rate * (1 - step / (rounds + 1)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-9)
    contexts = np.arange(side * side)
    predicted = p["in"][contexts % side] * p["near"] + p["in"][contexts // side] * p["far"]
    scores = (predicted @ p["out"].T + p["bias"]).astype(np.float64)
    scores -= scores.max(axis=1, keepdims=True)
    return ((scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


def score(docs: DataFrame, training: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs``, learned from ``training``."""
    counts = released(word_counts(training.select(F.col(text).alias("text"))))
    parts = Lexicon.of(counts)
    parts |= {"table": train(triples(training.select(F.col(text).alias("text")), parts))}
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))

    def make():
        known = Lexicon(shared.value)
        table = known.table.ravel()
        base_below = np.log10(known.total + 0.5 * (known.distinct + 1))
        below = np.log10(known.n + 0.5 * (known.v + 1))
        alone = np.zeros(CLASSES, dtype=bool)  # classes of one token have no share to take
        alone[:known.heads] = alone[END] = True

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, kinds, first = tokens(batch.column("text"))
            klass, c = known.look(hashes, kinds)
            full, context, begin = sequence(klass, first)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))

            def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
                sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
                return sums[at[1:]] - sums[at[:-1]]

            here = c >= 0
            above = np.where(here, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            n = np.diff(first) + 1
            base = per_row(above, first) - n * base_below + np.log10(known.ends + 0.5)
            inside = np.where(alone[klass], 0.0, above - below[klass])
            model = per_row(table[context * CLASSES + full], begin) + per_row(inside, first)
            seen = per_row(here, first) + (known.ends > 0)
            # Other words: one row for each word of a text, to be joined with its count.
            rest = np.flatnonzero(~here)
            pair = np.lexsort((hashes[rest], rows[rest]))
            rest = rest[pair]
            fresh = np.r_[True, (rows[rest][1:] != rows[rest][:-1]) | (hashes[rest][1:] != hashes[rest][:-1])] if len(rest) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(rest)))
            at = rest[at]
            ids = pa.concat_arrays([batch.column("id"), batch.column("id").take(pa.array(rows[at]))])
            tags = pa.concat_arrays([batch.column("tag"), batch.column("tag").take(pa.array(rows[at]))])
            fake = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(int(hashes[:1].sum()) & 0xFFFFFFFF))
            zero = np.zeros(len(at))
            return pa.RecordBatch.from_arrays(
                [ids, tags, pa.array(np.concatenate([fake, hashes[at]]).view(np.int64)),
                 pa.array(np.concatenate([np.zeros(len(n), np.int32), times.astype(np.int32)])),
                 pa.array(np.concatenate([n, zero.astype(np.int64)])), pa.array(np.concatenate([seen, zero])),
                 pa.array(np.concatenate([base, zero])), pa.array(np.concatenate([model, zero]))],
                names=["id", "tag", "h", "times", "n", "seen", "base", "model"])
        return run

    rows = emit(own, "text", "id bigint, tag bigint, h bigint, times int, n bigint, seen double, base double, model double", make)
    # A text's own row has times = 0 and a hash that only spreads it; it takes no count.
    rare = counts.filter(F.col("kind") >= 0).select(F.col("h").alias("word"), "c")
    joined = rows.join(rare, (F.col("h") == F.col("word")) & (F.col("times") > 0), "left")
    above = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    joined = joined.select("id", "tag", "n", (F.col("seen") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("seen"),
                           (F.col("base") + above).alias("base"), (F.col("model") + above).alias("model"), (F.col("times") == 0).cast("int").alias("own"))
    each = joined.groupBy("id", "tag").agg(F.sum("own").alias("m"), *[F.sum(c).alias(c) for c in ("n", "seen", "base", "model")])
    each = each.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select(F.col("id").alias(id), (F.col("n") / F.col("m")).cast("bigint").alias("n_tokens"),
                       F.round(F.col("seen") / F.col("m")).cast("bigint").alias("n_known"), F.lit(parts["total"]).cast("bigint").alias("train_tokens"),
                       (F.col("base") / F.col("m")).alias("base_score"), (F.col("model") / F.col("m")).alias("score"))
