"""The anchor scan of a track's islands over streaming Arrow batches.

``anchor_scan`` walks whole islands. ``speculative_scan`` walks overlapping stretches of an island, each from its own first point,
and tells where the walk of a stretch meets the one that starts at the stretch's last piece: from there on they are the same.

This module travels to the Python workers by value, so they need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from sojourn.constants import EARTH_RADIUS_M

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def anchor_scan(keys: list[str], radius_m: float, min_sec: int):
    """The kernel for ``mapInArrow``: rows arrive sorted by key, island and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker: _Walker | None = None
        last_key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = [batch.column(k) for k in [*keys, "island"]]
            starts = _group_starts(ids, batch.num_rows)
            lat, lng, ts = (batch.column(c).to_numpy() for c in ("lat", "lng", "ts_sec"))
            label = batch.column("semantic_label").to_pylist()
            out: list[tuple] = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(c[lo].as_py() for c in ids)
                if key != last_key:
                    if walker is not None:
                        out.extend(row for _, _, row in walker.finish())
                    walker, last_key = _Walker(key[:-1], radius_m, min_sec), key
                walker.feed(lat[lo:hi], lng[lo:hi], ts[lo:hi], label[lo:hi])
                out.extend(row for _, _, row in walker.take())
            if out:
                yield _to_batch(out, keys)
        if walker is not None:
            out = [row for _, _, row in walker.finish()]
            if out:
                yield _to_batch(out, keys)

    return run


def speculative_scan(keys: list[str], radius_m: float, min_sec: int):
    """The kernel for ``mapInArrow``: rows arrive sorted by key, island, stretch and position.

    ``last`` marks the rows of a stretch's last piece, ``final`` stretches at whose end the island ends. Each stretch yields its stays
    up to the meeting point and one row without times, whose ``pos`` is the meeting point (null if the walks do not meet).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch: _Stretch | None = None
        last_key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = [batch.column(k) for k in [*keys, "island", "stretch"]]
            starts = _group_starts(ids, batch.num_rows)
            columns = [batch.column(c).to_numpy() for c in ("lat", "lng", "ts_sec")]
            pos = batch.column("pos").to_numpy()
            last, final = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "final"))
            label = batch.column("semantic_label").to_pylist()
            out: list[tuple] = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(c[lo].as_py() for c in ids)
                if key != last_key:
                    if stretch is not None:
                        out.extend(stretch.finish())
                    stretch, last_key = _Stretch(key, radius_m, min_sec, bool(final[lo])), key
                cut = lo + int(np.searchsorted(last[lo:hi], True))
                for a, b, end in ((lo, cut, False), (cut, hi, True)):
                    if a < b:
                        stretch.feed(*(c[a:b] for c in columns), label[a:b], pos[a:b], end)
                out.extend(stretch.take())
            if out:
                yield _to_batch(out, keys, ["island", "stretch", "pos"])
        if stretch is not None:
            yield _to_batch(stretch.finish(), keys, ["island", "stretch", "pos"])

    return run


def _group_starts(columns: list[pa.Array], n: int) -> list[int]:
    changed = np.zeros(n, dtype=bool)
    changed[0] = True
    for c in columns:
        differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True)
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed).tolist()


def _to_batch(rows: list[tuple], keys: list[str], numbers: list[str] = []) -> pa.RecordBatch:
    names = [*keys, *numbers, "start_sec", "end_sec", "lat", "lng", "point_count", "semantic_label"]
    types = [pa.string()] * len(keys) + [pa.int64()] * (len(numbers) + 2) + [pa.float64(), pa.float64(), pa.int64(), pa.string()]
    columns = [pa.array(c) if i < len(keys) else pa.array(c, type=types[i]) for i, c in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _meters(lat1, lng1, lat2, lng2):
    h = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
         + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2)
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


class _Walker:
    """Anchor scan of one island. Buffers at most ``min_sec`` of points plus one batch.

    A run that has lasted ``min_sec`` is certain to be a stay, so from then on only sums are kept.
    """

    def __init__(self, key: tuple, radius_m: float, min_sec: int):
        self.key, self.radius, self.min_sec = key, radius_m, min_sec
        self.lat = self.lng = np.empty(0)
        self.ts = np.empty(0, dtype=np.int64)
        self.label: list[str | None] = []
        self.at = 0  # position of the first buffered point
        self.open: dict | None = None
        self.done: list[tuple] = []

    def take(self) -> list[tuple]:
        """Finished stays: position of the anchor, position after the last point, row."""
        done, self.done = self.done, []
        return done

    def feed(self, lat, lng, ts, label) -> None:
        self.lat = np.concatenate([self.lat, lat])
        self.lng = np.concatenate([self.lng, lng])
        self.ts = np.concatenate([self.ts, ts])
        self.label = self.label + label
        self._advance(final=False)

    def frontier(self) -> int:
        """The last position that the walk is known to reach: an undecided or open anchor, or the point after the last one."""
        return self.open["pos"] if self.open is not None else self.at

    def finish(self) -> list[tuple]:
        self._advance(final=True)
        self._close()
        return self.take()

    def _exit_from(self, lat0, lng0, begin: int) -> int:
        """First index at or after ``begin`` outside the anchor's radius (or the buffer's end)."""
        size, n = 64, len(self.ts)
        while begin < n:
            end = min(begin + size, n)
            outside = np.flatnonzero(_meters(lat0, lng0, self.lat[begin:end], self.lng[begin:end]) > self.radius)
            if outside.size:
                return begin + int(outside[0])
            begin, size = end, size * 4
        return n

    def _absorb(self, lo: int, hi: int) -> None:
        if hi <= lo:
            return
        run = self.open
        run["lat"] += float(self.lat[lo:hi].sum())
        run["lng"] += float(self.lng[lo:hi].sum())
        run["n"] += hi - lo
        run["end"] = int(self.ts[hi - 1])
        counts = run["labels"]
        for text in self.label[lo:hi]:
            if text:
                counts[text] = counts.get(text, 0) + 1

    def _begin(self, i: int) -> None:
        self.open = {"pos": self.at + i, "anchor": (self.lat[i], self.lng[i]), "start": int(self.ts[i]), "lat": 0.0, "lng": 0.0,
                     "n": 0, "end": 0, "labels": {}}

    def _close(self) -> None:
        run, self.open = self.open, None
        if run is None:
            return
        label = max(run["labels"], key=run["labels"].get) if run["labels"] else None
        self.done.append((run["pos"], run["pos"] + run["n"], (*self.key, run["start"], run["end"], run["lat"] / run["n"],
                                                              run["lng"] / run["n"], run["n"], label)))

    def _advance(self, final: bool) -> None:
        n, i = len(self.ts), 0
        if self.open is not None:
            i = self._exit_from(*self.open["anchor"], 0)
            self._absorb(0, i)
            if i < n:
                self._close()
        if i < n:
            i = self._scan_from(i, final)
        self.lat, self.lng, self.ts, self.label = self.lat[i:], self.lng[i:], self.ts[i:], self.label[i:]
        self.at += i

    def _scan_from(self, i: int, final: bool) -> int:
        """Walks anchors from ``i``; returns the first index that must stay buffered."""
        n = len(self.ts)
        # An anchor can only start a stay if the first point at least min_sec later is still inside its radius.
        offset = i
        later = np.searchsorted(self.ts, self.ts[offset:] + self.min_sec)
        known = np.minimum(later, n - 1)
        near = _meters(self.lat[offset:], self.lng[offset:], self.lat[known], self.lng[known]) <= self.radius
        near[later >= n] = not final  # undecided until more rows arrive; hopeless at the end
        candidates = offset + np.flatnonzero(near)
        while True:
            at = int(np.searchsorted(candidates, i))
            if at >= len(candidates):
                return n
            i = int(candidates[at])
            j = self._exit_from(self.lat[i], self.lng[i], i + 1)
            lasted = int(self.ts[j - 1] - self.ts[i])
            if lasted >= self.min_sec:
                self._begin(i)
                self._absorb(i, j)
                if j == n and not final:
                    return n
                self._close()
                i = j
                if i >= n:
                    return n
            elif j == n and not final:
                return i
            else:
                i += 1


class _Stretch:
    """The walk of a stretch and, over its last piece, the walk from that piece's first point."""

    def __init__(self, key: tuple, radius_m: float, min_sec: int, final: bool):
        self.key, self.final = key, final
        self.own, self.other = (_Walker(key[:-2], radius_m, min_sec) for _ in range(2))
        self.begin = self.piece = None  # first position of the stretch and of its last piece
        self.end = 0
        self.late: list[tuple] = []  # stays that reach into the last piece
        self.theirs: list[tuple] = []
        self.sure: list[tuple] = []

    def feed(self, lat, lng, ts, label, pos, last: bool) -> None:
        if self.begin is None:
            self.begin = self.own.at = int(pos[0])
        if last and self.piece is None:
            self.piece = self.other.at = int(pos[0])
        self.end = int(pos[-1]) + 1
        self.own.feed(lat, lng, ts, label)
        self._sort(self.own.take())
        if last:
            self.other.feed(lat, lng, ts, label)
            self.theirs += [(a, b) for a, b, _ in self.other.take()]

    def _sort(self, stays: list[tuple]) -> None:
        for a, b, row in stays:
            (self.sure if self.piece is None or b <= self.piece else self.late).append((a, b, row))

    def _row(self, a: int, row: tuple) -> tuple:
        head = len(self.key) - 2
        return (*self.key, a, *row[head:])

    def take(self) -> list[tuple]:
        sure, self.sure = self.sure, []
        return [self._row(a, row) for a, _, row in sure]

    def finish(self) -> list[tuple]:
        if self.final:
            self._sort(self.own.finish())
            self.theirs += [(a, b) for a, b, _ in self.other.finish()]
        meet = None
        if self.piece is not None:
            reach = [self.end if self.final else walk.frontier() for walk in (self.own, self.other)]
            both = np.ones(max(min(reach) - self.piece + 1, 0), dtype=bool)
            for a, b in [*[(a, b) for a, b, _ in self.late], *self.theirs]:
                both[max(a + 1 - self.piece, 0):max(b - self.piece, 0)] = False
            if both.any():
                meet = self.piece + int(both.argmax())
        stays = [self._row(a, row) for a, _, row in self.late if self.piece is None or (meet is not None and a < meet)]
        return self.take() + stays + [(*self.key, meet, None, None, None, None, None, None)]
