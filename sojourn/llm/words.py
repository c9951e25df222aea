"""Words of whole Arrow batches as numpy arrays: positions, 64-bit hashes, n-gram hashes.

All functions work on the UTF-8 bytes of many texts at once; nothing here loops over words in Python.
Rows are processed in slices of a few megabytes, so memory does not depend on the size of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
HASH_SPAN = 1 << 20
_PRIME = 0x9E3779B97F4A7C15


def byte_class(separators: bytes) -> np.ndarray:
    """Table of 256 flags: True where a byte belongs to a word."""
    flags = np.ones(256, dtype=bool)
    flags[list(separators)] = False
    return flags


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def bounds(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and for each text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = flags[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _letters(position: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix((((position << 8) | byte) + 1).astype(np.uint64) * np.uint64(_PRIME))


#: A random value for each byte at each of the first positions of a word.
_TABLE = _letters(np.arange(64)[:, None], np.arange(256)[None]).ravel()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes in every text, batch and task.

    The sum of random values, one for each pair of position and byte: no polynomial, so no pattern of letters makes words collide.
    """
    out, size = np.empty(len(starts), dtype=np.uint64), ends - starts
    upto, done = np.concatenate([[0], np.cumsum(size)]), 0
    while done < len(starts):
        last = max(done + 1, int(np.searchsorted(upto, upto[done] + HASH_SPAN, side="right")) - 1)
        own, begin = size[done:last], upto[done:last] - upto[done]
        at = np.arange(int(upto[last] - upto[done]))
        byte = data[at + np.repeat(starts[done:last] - begin, own)]
        position = at - np.repeat(begin, own)
        values = _TABLE[(position << 8) | byte] if own.max() <= 64 else _letters(position, byte)
        out[done:last] = np.add.reduceat(values, begin)
        done = last
    return mix(out + size.astype(np.uint64) * np.uint64(_PRIME))


def ngram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words by its first word, over text boundaries too; the caller leaves those out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    return mix(total)


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def attach(df: DataFrame, text: str, out: str, kind: str, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """``df`` with a column ``out`` of SQL type ``kind``, made in Arrow slices from the column ``text``.

    ``make`` runs once in each task and returns the function from texts to values. A column named ``out`` is replaced.
    """
    df = df.drop(out)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` {kind}").fields])
    names = schema.fieldNames()

    def run(batches):
        fn = make()
        for batch in batches:
            for part in sliced(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, fn(part.column(text))], names=names)

    return df.mapInArrow(run, schema)


def emit(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """Rows of ``schema`` that a function returns for each slice of ``df``."""

    def run(batches):
        fn = make()
        for batch in batches:
            for part in sliced(batch, text):
                if (rows := fn(part)) is not None and rows.num_rows:
                    yield rows

    return df.mapInArrow(run, schema)


def attach_rows(df: DataFrame, text: str, out: str, kind: str, make, drop: list[str]) -> DataFrame:
    """Like ``attach``; the function gets the whole rows, and the columns ``drop`` are left out of the result."""
    fields = [f for f in df.schema.fields if f.name not in drop]
    schema = StructType([*fields, *StructType.fromDDL(f"`{out}` {kind}").fields])
    keep, names = [f.name for f in fields], schema.fieldNames()

    def run(batches):
        fn = make()
        for batch in batches:
            for part in sliced(batch, text):
                rows = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.names.index(k)) for k in keep), fn(rows)], names=names)

    return df.mapInArrow(run, schema)
