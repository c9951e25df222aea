"""Toxicity by compression distance.

Both dictionaries begin with the same base, trained by Zstandard on windows of a few words of ordinary rows, so ordinary words cost
the same with either. The toxic one ends with pieces, counted over all drawn rows and not trained by Zstandard: word beginnings that
toxic rows hold far more often than ordinary ones. A piece is taken on evidence alone (a number of toxic rows, and a bound on
the chance of that number), however small its share of all toxic rows. The other ends with as many bytes of ordinary windows. Every text is cut
into windows of a few words, each window is compressed with both, and the difference of the lengths is its gain. Counts of
windows by gain, the largest gain and the mean gain go into a logistic function, fitted on labelled rows and weighted to
the shares of all labelled rows, so 0.5 is a calibrated threshold.

Training reads a sample of at most about ``sample`` rows of each label, picked by a hash of the id over all labelled rows, and a
few windows of each for the base; the bounds are parameters. Scoring reads whole texts, one pass, without a shuffle.

Null and empty texts have no windows and get the score of that. Without rows of both labels every score is the share of
toxic rows (0 without any). Rows that repeat are scored each, texts of any length whole, and equal texts alike. An empty table gives no
rows. A column named like the result is replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import released
from sojourn.llm.words import attach, emit

SAMPLE = 2000
WORDS = 6
BASE_BYTES = 64 << 10
PIECE_LENGTHS = (3, 4, 5, 6, 7, 8, 10)
#: Toxic rows that hold a piece, and how many times the share of ordinary rows their share is, at least.
PIECE_ROWS, PIECE_RATIO = 4, 8
#: Chance, at most, of so many toxic rows among those that hold a piece if it told nothing (Chernoff's bound).
PIECE_CHANCE = 1e-5
WINDOWS_OF_EACH = 24
AT_ONCE = 1 << 16


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(words: list[str], size: int = WORDS) -> list[bytes]:
    return [(" " + " ".join(words[i:i + size])).encode() for i in range(0, len(words), size)]


def pieces(words: list[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in PIECE_LENGTHS if len(w) >= k}


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary with entropy tables, or plain text where there are too few samples for one."""
    import zstandard

    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=32, d=6, steps=1).as_bytes()
        except zstandard.ZstdError:
            size //= 4
    return b"".join(samples)[:BASE_BYTES]


def surprise(t: int, o: int, toxic: int, ordinary: int) -> float:
    """Minus the logarithm of Chernoff's bound on the chance of ``t`` or more toxic rows among ``t + o``."""
    n, p = t + o, toxic / (toxic + ordinary)
    if t <= n * p:
        return 0.0
    return t * math.log(t / n / p) + (o * math.log(o / n / (1 - p)) if o else 0.0)


def chosen(counts: list[tuple[str, int, int]], toxic: int, ordinary: int) -> list[str]:
    """All pieces with evidence enough, the surest first; of pieces that begin alike only one."""
    sure = {p: surprise(t, o, toxic, ordinary) for p, t, o in counts
            if t >= PIECE_ROWS and t / toxic > PIECE_RATIO * (o + 0.5) / ordinary}
    kept: dict[str, None] = {}
    begun: set[str] = set()
    for p in sorted(sure, key=lambda p: (-round(sure[p], 6), -len(p), p)):
        begins = [p[:k] for k in range(1, len(p) + 1)]
        if sure[p] >= -math.log(PIECE_CHANCE) and p not in begun and not any(q in kept for q in begins):
            kept[p] = None
            begun.update(begins)
    return list(kept)


class Gains:
    """Compressed lengths of windows with either dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def compressor(content: bytes):
            given = z.ZstdCompressionDict(content)
            log = max(17, (len(content) + (1 << 15)).bit_length())
            how = z.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=5, min_match=3, target_length=64,
                                              strategy=z.STRATEGY_BTULTRA2, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False,
                                              write_dict_id=False, write_checksum=False)
            given.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=given, compression_params=how)

        self.both = compressor(ordinary), compressor(toxic)

    def sizes(self, compressor, some: list[bytes]) -> np.ndarray:
        out = compressor.multi_compress_to_buffer(some, threads=1)
        return np.fromiter((len(out[i]) for i in range(len(out))), dtype=np.int32, count=len(out))

    def of(self, some: list[bytes]) -> np.ndarray:
        ordinary, toxic = self.both
        parts = [self.sizes(ordinary, some[i:i + AT_ONCE]) - self.sizes(toxic, some[i:i + AT_ONCE]) for i in range(0, len(some), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def features(self, texts: list[str | None]) -> np.ndarray:
        cut = [windows(words_of(t)) for t in texts]
        first = np.r_[0, np.cumsum([len(c) for c in cut], dtype=np.int64)]
        gains = self.of([w for c in cut for w in c])
        total = {k: np.r_[0, np.cumsum(gains >= k)] for k in (1, 2, 3, 4)}
        count = {k: (t[first[1:]] - t[first[:-1]]).astype(np.float64) for k, t in total.items()}
        n = np.diff(first) + 1.0
        mass = np.r_[0, np.cumsum(gains)]
        most = np.array([gains[a:b].max(initial=0) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=np.float64)
        return np.c_[count[1] / np.sqrt(n), count[2] / np.sqrt(n), count[3] / np.sqrt(n), np.minimum(count[3], 5),
                     np.minimum(count[4], 5), most, np.log(n), (mass[first[1:]] - mass[first[:-1]]) / n]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> dict:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, total = np.zeros(z.shape[1]), weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) / total + penalty * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z / total + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "weights": w}


def chance(fit: dict, x: np.ndarray) -> np.ndarray:
    z = np.c_[(x - fit["mean"]) / fit["spread"], np.ones(len(x))]
    return 1 / (1 + np.exp(-np.clip(z @ fit["weights"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          toxic: str = "toxic") -> dict:
    """The dictionaries and the calibration, as plain data. ``docs``: the rows that may be learned from."""
    marks = labels.filter(F.col(label_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(
        F.col(label_id).cast("bigint").alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in docs.select(F.col(id).cast("bigint").alias("id")).join(marks, "id").groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"share": n1 / max(1, n1 + n0)}
    share = {1: min(1.0, sample / n1), 0: min(1.0, sample / n0)}
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    marks = marks.filter(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20))
    # Most texts are left out before anything is shuffled, and the sample is written once.
    some = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).filter(place < max(share.values()) * (1 << 20))
    drawn = released(some.join(marks, "id").select("id", "text", "toxic"))

    def count():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = Counter(), Counter()
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[1 if y else 0].update(pieces(words_of(t)))
            rows = [(p, n, seen[0][p]) for p, n in seen[1].items()] + [(p, 0, n) for p, n in seen[0].items() if p not in seen[1]]
            p, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                              names=["piece", "t", "o"])
        return run

    def cut():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = [] if y else windows(words_of(t))
                out += own[::max(1, len(own) // WINDOWS_OF_EACH)][:WINDOWS_OF_EACH]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])
        return run

    held = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    m1, m0 = max(1, held.get(1, 0)), max(1, held.get(0, 0))
    counts = emit(drawn, "text", "piece string, t bigint, o bigint", count).groupBy("piece").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = counts.filter((F.col("t") >= PIECE_ROWS) & (F.col("t") / m1 > PIECE_RATIO * (F.col("o") + 0.5) / m0))
    best = chosen([(r.piece, r.t, r.o) for r in counts.collect()], m1, m0)
    ordinary = sorted(bytes(r.w) for r in emit(drawn, "text", "w binary", cut).collect())
    spread = np.random.default_rng(5).permutation(len(ordinary))
    ordinary = [ordinary[i] for i in spread]
    base, tail = trained(ordinary, BASE_BYTES), "".join(" " + p for p in reversed(best)).encode()
    like = b"".join(ordinary)
    model = {"share": n1 / (n1 + n0), "pieces": best, "ordinary": base + like[:len(tail)].ljust(len(tail)), "toxic": base + tail}

    def measure():
        gains = Gains(model["ordinary"], model["toxic"])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = gains.features(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))],
                                              names=["id", "toxic", "x"])
        return run

    rows = sorted((r.id, r.toxic, r.x) for r in emit(drawn, "text", "id bigint, toxic int, x array<double>", measure).collect())
    y = np.array([1.0 if r[1] else 0.0 for r in rows])
    model["fit"] = logistic(np.array([r[2] for r in rows]), y, np.where(y == 1, n1 / m1, n0 / m0))
    return model


def score(docs: DataFrame, model: dict, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``: the score of the whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        gains = Gains(known["ordinary"], known["toxic"]) if "fit" in known else None

        def run(texts: pa.Array) -> pa.Array:
            if gains is None:
                return pa.array(np.full(len(texts), known["share"]), pa.float64())
            return pa.array(chance(known["fit"], gains.features(texts.to_pylist())), pa.float64())
        return run

    return attach(docs, text, out, "double", make)
