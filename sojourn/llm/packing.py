"""Packing of token sequences with minimum bin slack.

Every document becomes token ids and an end id. Whole sequences of ``size`` ids are cut off its front; what remains of each
document is a length below ``size``. Bins are filled from a pool of such remainders: the longest one opens the bin, and a
subset-sum over the multiset of the remaining lengths (a bit set of reachable sums, counts split into powers of two) finds
the sum closest to the room left; walking the bit sets back gives how many of each length to take.

The pool holds a bounded number of remainders at a time, so a task's memory does not depend on the number of documents.
Only lengths and checksums are shuffled, never texts or ids. Tokenising keeps the ids of words in bounded
tables: words are independent of each other in this vocabulary, and what the fast path cannot decide is left to the library.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.words import SPACED, bounds, emit, raw, word_hashes

SIZE = 2048
END_ID = 1
POOL = 8192
CACHE_ENTRIES = 600_000
WORDS_AT_ONCE = 1 << 19
#: The pattern by which the vocabulary splits words (a fixed value of the tokenizer file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts through a table of words.

    White space separates words in the vocabulary, so a text's ids are those of its words in turn. Words are looked up by a
    64-bit hash in a sorted table. A new word of plain Latin letters is split by the vocabulary's own pattern, and only parts
    not yet known go to the library, many at once: their ids are told apart by the tokens that end a part. Every other new
    word is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        special = set(self.tokenizer.get_added_tokens_decoder())
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>") and i not in special
        self.split = regex.compile(PIECES).findall
        self.odd = regex.compile(r"[^\u0000-įı-ɏ]|<\|").search
        self.parts: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        """An empty table: the end id alone, which no word refers to."""
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.array([END_ID], dtype="<u4")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 512):
            some = parts[k:k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                whole, at = ids.tobytes(), [0, *(cut * 4).tolist()]
                self.parts.update(zip(some, [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
            else:
                self.parts.update(zip(some, self._plain(some), strict=True))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        texts = b"\n".join(words).decode().split("\n")
        odd = {i for i, t in enumerate(texts) if self.odd(t)} if self.odd("".join(texts)) else set()
        split = [self.split(t.lower()) if i not in odd else () for i, t in enumerate(texts)]
        self._learn(list({p for s in split for p in s} - self.parts.keys()))
        get = self.parts.__getitem__
        ids = [get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for s in split]
        for i, x in zip(sorted(odd), self._plain([texts[i] for i in sorted(odd)]), strict=True):
            ids[i] = x
        return ids

    def _know(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds words, given by their sorted hashes."""
        if len(self.hashes) + len(words) > CACHE_ENTRIES and len(self.hashes):
            raise OverflowError
        ids = self._ids(words)
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.size = np.insert(self.hashes, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype="<u4")])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in turn, each with the end id, and where each text's begin (one more at the end)."""
        data, offsets = raw(texts)
        starts, ends, first = bounds(data, offsets, SPACED)
        done, counts = [], np.zeros(len(starts) + 1, dtype=np.int64)
        hashes = word_hashes(data, starts, ends)
        for a in range(0, len(starts), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(starts))
            own, index, back = np.unique(hashes[a:b], return_index=True, return_inverse=True)
            for attempt in range(2):
                at = np.searchsorted(self.hashes, own)
                new = np.flatnonzero(np.r_[self.hashes, np.uint64(0)][at] != own) if len(self.hashes) else np.arange(len(own))
                try:
                    if len(new):
                        self._know(own[new], [data[x:y].tobytes() for x, y in zip(
                            starts[a + index[new]].tolist(), ends[a + index[new]].tolist(), strict=True)])
                    break
                except OverflowError:  # the table is full: begin a new one
                    self._clear()
            at = np.searchsorted(self.hashes, own)[back]
            size = self.size[at]
            counts[a + 1:b + 1] = size
            done.append(self.flat[np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        upto = np.cumsum(counts)[first]
        ids = np.insert(np.concatenate(done) if done else np.zeros(0, "<u4"), upto[1:], np.uint32(END_ID)).astype("<u4", copy=False)
        return ids, upto + np.arange(len(first))


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: Spark keeps workers, so words learned in one task serve the next."""
    import tokenizers

    held = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def closest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``room`` from below as it can be."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in reversed(lengths[:bisect_left(lengths, room + 1)]):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


class Pool:
    """Remainders by length."""

    def __init__(self, size: int):
        self.size, self.lengths, self.by_length, self.counts, self.held = size, [], {}, {}, 0

    def add(self, length: int, piece: tuple) -> None:
        if not self.counts.get(length):
            insort(self.lengths, length)
        self.by_length.setdefault(length, []).append(piece)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.held += 1

    def _take(self, length: int, n: int) -> list[tuple]:
        stack = self.by_length[length]
        taken = stack[len(stack) - n:]
        del stack[len(stack) - n:]
        self.counts[length] -= n
        self.held -= n
        if not stack:
            del self.by_length[length], self.counts[length]
            self.lengths.remove(length)
        return taken

    def bin(self) -> list[tuple]:
        longest = self.lengths[-1]
        pieces = self._take(longest, 1)
        for length, n in closest(self.lengths, self.counts, self.size - longest).items():
            pieces += self._take(length, n)
        return pieces


PIECE = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _lengths(docs: DataFrame, path: str, size: int) -> DataFrame:
    def make():
        table = encoder(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, first = table.encode(batch.column("text"))
            view, at = memoryview(ids).cast("B"), (first * 4).tolist()
            sums = [[zlib.crc32(view[x:min(x + 4 * size, b)]) for x in range(a, b, 4 * size)]
                    for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(first)), pa.array(sums, pa.list_(pa.int64()))],
                                              names=["id", "n", "sums"])
        return run

    return emit(docs, "text", "id bigint, n bigint, sums array<bigint>", make)


def pack(docs: DataFrame, tokenizer: str, *, size: int = SIZE, pool: int = POOL, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: document, place in it, checksum of its ids, sequence and place there.

    Null and empty texts are the end id alone. Rows that repeat are packed each, rows of one id and length in any order. A null id stays
    null. Texts of any length fill as many sequences as they need. An empty table gives no rows. No other columns are read.
    """
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    lengths = _lengths(own, tokenizer, size).repartition("id").sortWithinPartitions("id", "n")

    def run(batches):
        from pyspark import TaskContext

        room, rows = Pool(size), []
        sequence = TaskContext.get().partitionId() << 40
        names = PIECE.replace(" bigint", "").split(", ")

        def full(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, crc, total in pieces:
                rows.append((doc, start, length, crc, total, sequence, offset))
                offset += length
            sequence += 1

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc, n, sums in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "sums")), strict=True):
                for k in range(n // size):
                    full([(doc, k * size, size, sums[k], n)])
                if rest := n % size:
                    room.add(rest, (doc, n - rest, rest, sums[-1], n))
                while room.held > pool:
                    full(room.bin())
            yield out()
        while room.held:
            full(room.bin())
            if len(rows) > 1 << 16:
                yield out()
        yield out()

    return lengths.mapInArrow(run, PIECE)
