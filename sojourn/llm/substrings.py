"""Substring deduplication by relative Lempel-Ziv parsing.

A document is parsed against the text of all documents with a smaller id: the parse takes, from left to right, factors of
words that the reference holds, and a factor of ``window`` words or more is a duplicate span. The reference is indexed in
blocks of ``window`` consecutive words, dealt over the cluster by their hash, so a factor is a run of positions whose
blocks are all indexed under a smaller id; where one factor ends and the next begins, the blocks that straddle the
boundary are looked up too, so no duplicate block is lost at it.

Not every block is indexed. Anchors (minimizers of the hashes of ``SEED`` words over each block) are chosen by content,
so equal blocks hold equal anchors; only blocks around an anchor that at least two different texts share can be duplicates,
and only those enter the index. All steps are linear in the number of words: nothing forms pairs of documents. Whole copies
of a text are found by its digest first and never enter the index.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words and keep nothing. Rows with equal ids are
not duplicates of each other. Rows with a null id are neither parsed nor indexed. A column named like the result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.stages import fresh, released
from sojourn.llm.words import SPACED, attach_rows, bounds, emit, ngram_hashes, raw, word_hashes

WINDOW = 50
SEED = 16
TAG = 20
RESULT = ("struct<n_words:bigint,n_removed:bigint,spans:array<struct<first:bigint,end:bigint>>,kept:string,kept_sha256:string>")


def scan(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = raw(texts)
    starts, ends, first = bounds(data, offsets, SPACED)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the seeds that are the smallest of some window of their text, and the hashes of all seeds."""
    seeds = ngram_hashes(hashes, seed)
    wide = window - seed + 1
    if len(hashes) < window:
        return np.zeros(0, np.int64), seeds
    least = np.lib.stride_tricks.sliding_window_view(seeds, wide).argmin(axis=1) + np.arange(len(seeds) - wide + 1)
    return np.unique(least[inside(first, window, len(least))]), seeds


def inside(first: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each word, whether a window that begins there ends in the same text."""
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + window <= end


def tagged(positions, digest: np.ndarray):
    """Word positions with a few bits of the text's digest, which tell rows of one id with different texts apart."""
    return positions | ((digest & ((1 << TAG) - 1)) << 32)


def _anchor_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, _, _, first, hashes = scan(batch.column("text"))
            at, seeds = anchors(hashes, first, window, seed)
            doc = np.searchsorted(first, at, side="right") - 1
            digest = batch.column("h").to_numpy()[doc]
            return pa.RecordBatch.from_arrays(
                [pa.array(seeds[at].view(np.int64)), pa.array(batch.column("id").to_numpy()[doc]), pa.array(digest),
                 pa.array(tagged(at - first[doc], digest))], names=["seed", "id", "h", "pos"])
        return run

    return emit(docs, "text", "seed bigint, id bigint, h bigint, pos bigint", make)


def _block_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Hashes of the blocks around the given anchors of each document."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, _, _, first, hashes = scan(batch.column("text"))
            blocks = ngram_hashes(hashes, window)
            tags = (batch.column("h").to_numpy() & ((1 << TAG) - 1)) << 32
            values = batch.column("at").flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("at")).to_numpy())
            good = (values >> 32 << 32) == tags[doc]
            doc, at = doc[good], (values[good] & 0xFFFFFFFF) + first[doc[good]]
            # A block that begins between lo and hi holds the anchor; overlapping ranges are merged by counting.
            lo, hi = np.maximum(at + seed - window, first[doc]), np.minimum(at, first[doc + 1] - window)
            lo, hi = lo[hi >= lo], hi[hi >= lo]
            cover = np.zeros(len(hashes) + 1, dtype=np.int32)
            np.add.at(cover, lo, 1)
            np.add.at(cover, hi + 1, -1)
            begin = np.flatnonzero(np.cumsum(cover) > 0)
            doc = np.searchsorted(first, begin, side="right") - 1
            digest = batch.column("h").to_numpy()[doc]
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks[begin].view(np.int64)), pa.array(batch.column("id").to_numpy()[doc]),
                 pa.array(tagged(begin - first[doc], digest))], names=["block", "id", "pos"])
        return run

    return emit(docs, "text", "block bigint, id bigint, pos bigint", make)


def factors(begins: list[int], window: int) -> list[list[int]]:
    """Greedy parse: the longest runs of words covered by blocks that begin at the given positions."""
    spans: list[list[int]] = []
    for at in begins:
        if spans and at <= spans[-1][1]:
            spans[-1][1] = at + window
        else:
            spans.append([at, at + window])
    return spans


def duplicate_blocks(docs: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``(id, at)``: for each document the begins of its blocks that also begin in a document of smaller id.

    A begin of -1 stands for a whole copy of a document of smaller id.
    """
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    own = own.filter("id IS NOT NULL AND text IS NOT NULL")
    ids = own.select("id", F.unhex(F.md5("text")).alias("digest"), "h")
    firsts = ids.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    copies = released(ids.join(firsts.select("digest", "least"), "digest").filter("id > least")
                          .select("id", tagged_column(F.lit(-1), F.col("h")).alias("pos")).distinct())

    rows = _anchor_rows(own, window, seed)
    shared = rows.groupBy("seed").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("seed")
    shared = released(shared)  # read from a table, the join can split a seed that many texts hold
    near = rows.select("seed", "id", "pos").join(shared, "seed").select("id", "pos")
    # Of an id with several texts only the copied one is done with.
    tag = F.shiftright("pos", 32).alias("tag")
    near = near.select("*", tag).join(copies.select("id", tag), ["id", "tag"], "left_anti")
    at = near.groupBy("id").agg(F.collect_list("pos").alias("at"))
    blocks = released(_block_rows(own.select("id", "h", "text").join(at, "id").select("id", "h", "text", "at"), window, seed))

    index = blocks.groupBy("block").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    index = released(index.select("block", "least"))  # read from a table, the join can split a block that many texts hold
    found = blocks.join(index, "block").filter("id > least").select("id", "pos")
    return found.unionByName(copies).groupBy("id").agg(F.collect_list("pos").alias("at"))


def tagged_column(pos, digest):
    return pos.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft(digest.bitwiseAND(F.lit((1 << TAG) - 1)), 32))


def parse(docs: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text", seed: int = SEED,
          out: str = "parsed") -> DataFrame:
    """``docs`` with a struct ``out``: words, removed words, duplicate spans (first word, end), kept words and their digest."""
    docs = docs.drop(out)
    key, begins_, tag_ = (fresh(f"{out}_{c}", docs) for c in ("id", "at", "tag"))
    found = duplicate_blocks(docs, window=window, id=id, text=text, seed=seed).select(F.col("id").alias(key), F.col("at").alias(begins_))
    joined = docs.join(found, docs[id].cast("bigint") == F.col(key), "left").drop(key)
    joined = joined.withColumn(tag_, F.xxhash64(text).bitwiseAND(F.lit((1 << TAG) - 1)))
    schema = joined.schema

    def make():
        def run(row: pa.StructArray) -> pa.Array:
            at, tags = row.field(begins_).to_pylist(), row.field(tag_).to_pylist()
            done = []
            for body, begins, tag in zip(row.field(text), at, tags, strict=True):
                words = (body.as_py() or "").encode().split()
                n, spans = len(words), []
                own = sorted({p & 0xFFFFFFFF for p in begins or () if p >> 32 == tag})
                if own and own[-1] == 0xFFFFFFFF:
                    spans = [[0, n]] if n >= window else []
                elif own:
                    spans = factors(own, window)
                for a, b in reversed(spans):
                    del words[a:b]
                kept = b" ".join(words)
                done.append({"n_words": n, "n_removed": n - len(words), "spans": [{"first": a, "end": b} for a, b in spans],
                             "kept": kept.decode(), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
            return pa.array(done, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)),
                                                  ("kept", pa.string()), ("kept_sha256", pa.string())]))
        return run

    return attach_rows(joined, text, out, RESULT, make, drop=[begins_, tag_])


def without_duplicates(docs: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with duplicate words taken out of ``text`` (and ``size`` counted anew); rows of which nothing is left go.

    Texts that lose nothing stay as they are, to the character.
    """
    own = fresh("parsed", docs)
    out = parse(docs, window=window, id=id, text=text, out=own)
    out = out.filter(f"{own}.n_removed = 0 OR {own}.n_removed < {own}.n_words")
    cut = F.col(f"{own}.n_removed") > 0
    columns = {text: F.when(cut, F.col(f"{own}.kept")).otherwise(F.col(text))}
    if size in docs.columns:
        columns[size] = F.when(cut, F.length(f"{own}.kept").cast(docs.schema[size].dataType)).otherwise(F.col(size))
    return out.withColumns(columns).select(docs.columns)
