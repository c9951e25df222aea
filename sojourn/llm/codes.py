"""Product codes of vectors, learned by rounds of assignment and averaging, with slice-and-intersect search.

A vector is cut into equal parts, and each part is coded by the nearest entry of its codebook. The search sorts the entries along
each dimension and keeps prefix masks: bit e of mask j is set if entry e is one of the first j. A radius selects a range
of each dimension, whose entries are the XOR of two prefix masks; the AND over the dimensions holds every entry within the
radius, since no coordinate differs by more than the distance. An entry found inside the radius is therefore compared with
all that can be nearer, and the search is exact. It starts with the radius that the last round's errors suggest; parts that find nothing
inside widen theirs, to the distance of the best entry seen or else to its double.

Spark keeps the vectors, quantised once. In each round a task adds up its parts by entry, Spark adds up the tasks, and only the
codebooks (entries x parts x width numbers) visit the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import released

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Largest magnitude of a quantised component, so that squared distances of 2,048 dimensions fit 64 bits.
LIMIT = 1 << 25
SLICE_ROWS = 4096


def quantised(rows: DataFrame, *, id: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``(id, label, q)`` of the rows whose vector is whole, finite and of the table's width."""
    v = F.col("v")
    own = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite)
    small = F.forall(v, lambda x: F.abs(x) <= F.lit(LIMIT // scale))
    cut = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    message = F.lit(f"vector components above {LIMIT // scale} cannot be coded")
    kept = released(own.select("id", "label", F.when(small, cut).otherwise(F.raise_error(message).cast("array<int>")).alias("q")))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "q").select(F.size("q")).first()
    return kept.filter(F.size("q") == first[0]) if first else kept


class Book:
    """Entries of one part, sorted along each dimension, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()
        words = -(-k // 64)
        bit = np.zeros((k, words), np.uint64)
        bit[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, k + 1, words), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(bit[order.T], axis=1)

    def spacing(self) -> int:
        """A first radius: the middle distance of an entry to the next of another value (1 if there is none)."""
        apart = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        nearest = [row[row > 0].min() for row in apart if (row > 0).any()]
        return radius_of(np.array([np.median(nearest)]))[0] if nearest else 1

    def candidates(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries of which no coordinate is further away than the radius."""
        mask = np.full((len(q), self.prefix.shape[2]), ~np.uint64(0))
        for d, (line, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(line, q[:, d] - radius, side="left")
            high = np.searchsorted(line, q[:, d] + radius, side="right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, q: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of ties) and its squared distance, for each row of ``q``."""
        code = np.full(len(q), -1)
        best = np.full(len(q), np.iinfo(np.int64).max)
        open_, radius = np.arange(len(q)), np.full(len(q), max(int(first), 1))
        while len(open_):
            mask = self.candidates(q[open_], radius)
            for e, entry in enumerate(self.entries):
                at = open_[(mask[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) == 1]
                far = ((q[at] - entry) ** 2).sum(axis=1)
                better = (far < best[at]) | ((far == best[at]) & (e < code[at]))
                code[at[better]], best[at[better]] = e, far[better]
            seen = code[open_] >= 0
            within = seen & (best[open_] <= radius * radius)
            reach = radius * 2
            reach[seen] = radius_of(best[open_[seen]])
            open_, radius = open_[~within], reach[~within]
        return code, best


def radius_of(squares: np.ndarray) -> np.ndarray:
    """The smallest whole numbers whose squares are not below the given ones."""
    r = np.ceil(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return r + (r * r < squares)


@dataclass
class Codebooks:
    entries: np.ndarray  # (parts, entries, width)
    radius: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()

    def coder(self):
        """A function from a column of vectors to codes and squared distances, both (rows, parts)."""
        books = [Book(e) for e in self.entries]
        count, _, width = self.entries.shape

        def code(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), count, width)
            found = [book.nearest(q[:, p], r) for p, (book, r) in enumerate(zip(books, self.radius, strict=True))]
            return q, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)
        return code


def sliced(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)  # never empty


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, k, width = books.entries.shape

    def run(batches):
        code = books.coder()
        sums = np.zeros((parts, k, width + 2), np.int64)  # components, then count and error
        for batch in sliced(batches):
            q, codes, errors = code(batch.column("q"))
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                own = codes[order, p]
                begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                row = np.concatenate([q[:, p], np.ones((len(q), 1), np.int64), errors[:, p, None]], axis=1)
                sums[p, own[begin]] += np.add.reduceat(row[order], begin, axis=0)
        used = np.flatnonzero(sums[:, :, width].ravel())
        rows = sums.reshape(parts * k, width + 2)[used]
        at = np.tile(np.arange(width + 2), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 2)), pa.array(at), pa.array(rows.ravel())], names=["entry", "at", "x"])

    found = vectors.select("q").mapInArrow(run, "entry bigint, at bigint, x bigint")
    sums = np.zeros((parts * k, width + 2), dtype=object)
    for entry, at, x in found.groupBy("entry", "at").agg(F.sum("x")).collect():
        sums[entry, at] = x
    flat = books.entries.reshape(parts * k, width).copy()
    for entry in range(parts * k):
        if n := sums[entry, width]:
            flat[entry] = [s // n for s in sums[entry, :width]]
    total = sums.reshape(parts, k, width + 2)[:, :, width:].sum(axis=1)
    radius = [int(radius_of(np.array([max(int(e), 1) // max(int(n), 1)]))[0]) for n, e in total]
    return Codebooks(flat.reshape(parts, k, width), radius)


def learn(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that start from the vectors of the smallest ids; None without vectors."""
    start = [r.q for r in vectors.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(entries).collect()]
    if not start:
        return None
    first = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    books = Codebooks(first, [int(Book(e).spacing()) for e in first])
    for _ in range(rounds):
        books = _round(vectors, books)
    return books


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code, error)`` of each vector."""

    def run(batches):
        code = books.coder()
        for batch in sliced(batches):
            _, codes, errors = code(batch.column("q"))
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([text[a:a + step] for a in range(0, len(text), step)], pa.string()),
                 pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of each row whose vector can be coded.

    Left out are null and empty vectors, those with a null, NaN or infinite component, and those whose length is no multiple of
    ``parts`` or differs from that of the kept row of smallest id. A component beyond 8,192 is an error, not a wrong code. The codebooks
    start from the vectors of the smallest ids (null ids last, equal ids by vector); with fewer rows than ``entries`` there are so many
    entries. Rows that repeat count each time. Null labels are one label. An empty table gives no rows. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = quantised(rows, id=id, vector=vector, label=label, scale=scale, parts=parts)
    books = learn(vectors, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return vectors.select(F.col("id").alias(id), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                              F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = released(coded(vectors, books))
    totals = released(found.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    # Read from a table, the totals are broadcast if they are small; else a hot label's rows are split by the join.
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
