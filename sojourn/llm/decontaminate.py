"""Benchmark decontamination: Wu-Manber search for word windows of test items in documents.

Patterns are the windows of ``size`` consecutive words of each item (the whole item where it is shorter). Patterns of one
length share a table of shifts by the hash of a block of words: a block that ends no pattern prefix lets the search skip
ahead, a shift of zero selects the bucket of patterns that end in this block, and the words themselves are compared.

The items are dealt into blocks of bounded size; each block is broadcast and searched for in one pass over the documents,
with the hits so far carried along. Documents are never shuffled.

Nulls and texts without words have no words, hence no hits and no windows. Repeated items each count under their own id
(equal ids count once); items without an id are searched for and hit, but are no items by name. Rows that repeat are searched each. Empty tables give empty results or no hits. A column of
``docs`` that is named like the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import fresh
from sojourn.llm.words import ALNUM, attach, bounds, lower_ascii, ngram_hashes, raw, word_hashes
from sojourn.operators.staging import staged_table

WINDOW = 10
BLOCK_WORDS = 3
SHIFT_BITS = 20
#: Bytes of item texts that one broadcast holds at most (a single larger item makes a block of its own).
BLOCK_BYTES = 8 << 20
RESULT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<string>,items_sha256:string,contaminated:boolean,hits:binary>"


def item_words(text: str | None) -> list[bytes]:
    data, offsets = raw(pa.array([text or ""]))
    data = lower_ascii(data)
    starts, ends, _ = bounds(data, offsets, ALNUM)
    whole = data.tobytes()
    return [whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Patterns:
    """Shift table and buckets of all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, dtype=np.int64)
        self.buckets: dict[int, list[tuple[tuple[bytes, ...], list[str]]]] = {}
        keys = list(patterns)
        words = [w for k in keys for w in k]
        size = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(size)
        hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
        blocks = ngram_hashes(hashes, self.block)
        for i, key in enumerate(keys):
            first = i * length
            for j in range(length - self.block + 1):
                at = blocks[first + j]
                slot = int(at >> np.uint64(64 - SHIFT_BITS))
                self.shift[slot] = min(self.shift[slot], length - self.block - j)
            self.buckets.setdefault(int(blocks[first + length - self.block]), []).append((key, patterns[key]))

    def search(self, data: bytes, starts: list[int], ends: list[int], blocks: np.ndarray, shifts: list[int],
               first: int, last: int) -> Iterable[tuple[int, list[str]]]:
        """First word and items of each occurrence between the words ``first`` and ``last`` of a batch."""
        at, span, reach = first, self.length - self.block, last - self.length
        while at <= reach:
            step = shifts[at + span]
            if step:
                at += step
                continue
            for key, items in self.buckets.get(int(blocks[at + span]), ()):
                if all(data[starts[at + j]:ends[at + j]] == key[j] for j in range(self.length)):
                    yield at, items
            at += 1


def tables(items: list[tuple[str, str | None]], size: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = item_words(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            owners = by_length.setdefault(n, {}).setdefault(tuple(words[i:i + n]), [])
            if item not in owners:
                owners.append(item)
    return [Patterns(n, p) for n, p in sorted(by_length.items())]


def _pass(docs: DataFrame, items, size: int, text: str, out: str, before: bool) -> DataFrame:
    carried = fresh(f"{out}_before", docs)
    if before:
        docs = docs.withColumnRenamed(out, carried)

    def make():
        patterns = tables(items.value, size)

        def run(texts: pa.Array) -> pa.Array:
            data, offsets = raw(texts)
            data = lower_ascii(data)
            starts, ends, first = bounds(data, offsets, ALNUM)
            hashes = word_hashes(data, starts, ends)
            hit, found = np.zeros(len(starts), dtype=bool), [set() for _ in range(len(texts))]
            whole, s, e = data.tobytes(), starts.tolist(), ends.tolist()
            for p in patterns:
                blocks = ngram_hashes(hashes, p.block)
                shifts = p.shift[(blocks >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)].tolist()
                for k in range(len(texts)):
                    for at, owners in p.search(whole, s, e, blocks, shifts, int(first[k]), int(first[k + 1])):
                        hit[at:at + p.length] = True
                        found[k].update(owners)
            rows = []
            for k in range(len(texts)):
                own, names = hit[first[k]:first[k + 1]], sorted(found[k] - {None})
                rows.append({"n_words": len(own), "n_hit": int(own.sum()), "n_items": len(names), "items": names,
                             "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                             "contaminated": bool(own.any()), "hits": np.packbits(own).tobytes() if own.any() else b""})
            return pa.array(rows, type=pa.struct([
                ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
                ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hits", pa.binary())]))
        return run

    docs = attach(docs, text, out, RESULT, make)
    if before:
        docs = _merged(docs, out, carried)
    return docs


def _merged(docs: DataFrame, out: str, carried: str) -> DataFrame:
    """Hits of two passes over the same text as one."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(carried).to_pylist(), batch.column(out).to_pylist(), strict=True):
                n = a["n_words"]
                bits = np.zeros(n, dtype=bool)
                for x in (a, b):
                    if x["hits"]:
                        bits |= np.unpackbits(np.frombuffer(x["hits"], np.uint8), count=n).astype(bool)
                names = sorted({*a["items"], *b["items"]})
                rows.append(a | {"n_hit": int(bits.sum()), "n_items": len(names), "items": names, "contaminated": bool(bits.any()),
                                 "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                                 "hits": np.packbits(bits).tobytes() if bits.any() else b""})
            keep = [i for i, f in enumerate(batch.schema) if f.name not in (out, carried)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(rows, type=batch.column(out).type)],
                names=[*(batch.schema.names[i] for i in keep), out])

    return docs.mapInArrow(run, docs.drop(carried).schema)


def search(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, text: str = "text", item: str = "item_id",
           item_text: str = "text", out: str = "match", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: words, hit words (count and bit map), items that occur, and whether any does."""
    spark = docs.sparkSession
    items = items.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in own.toLocalIterator()])
        docs = _pass(docs, shared, size, text, out, k > 0)
        if k < blocks - 1:
            docs = staged_table(docs)
    return docs
