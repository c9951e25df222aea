"""Near-duplicate groups by an inverted join of MinHash signatures.

A text's set holds the hashes of its distinct ``k``-word shingles; its signature names, for each coordinate, the shingle that a random
multiplier sends lowest. Two sets agree in a coordinate with the probability of their similarity, so a link agrees in ``t`` coordinates
at least but for a chance of ``MISS``, from the binomial tail at the threshold.

Every (coordinate, value) pair is a posting list of the sets that have it. Lists of one set are dropped, and so are sets that are
left in fewer than ``t`` lists. Any two sets with ``t`` common lists share one of the first c - t + 1 of the c lists of either, in any
order that all agree on, so each set is posted under its shortest lists only: a passage that many texts hold makes long lists,
which stay unused as long as it fills less than t coordinates of a text.

Within a list every set is paired with the smallest one. Pairs are counted in full signatures, and those that reach ``t`` are
confirmed on the shingles of both texts. Lists whose sets are then still in several components are gathered to clusters by shared
lists and compared in tiles, where an inverted index of signatures is merged with skipping: of a set's lists the longest t - 1 are
never read, since what reaches t is in another one; what the others hold is counted in full, and confirmed on the sets.

Equal sets are one node. Tiles are bounded by number and bytes, and sets of sizes that cannot link do not meet. So n copies cost n
comparisons as a rule, and no list, cluster or component is ever held by one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import tiles
from sojourn.llm.similar import components, node_of, shingle_sets
from sojourn.llm.stages import released
from sojourn.llm.words import emit, mix

SHINGLE = 4
THRESHOLD = Fraction(80, 100)
COORDINATES = 64
#: Chance of losing a link of exactly the threshold's similarity; closer sets are lost far less often.
MISS = 1e-9
SPAN = 1 << 15


def matches_needed(coordinates: int, threshold: Fraction, miss: float = MISS) -> int:
    """The most matches that a link has at least, but for a chance of ``miss``."""
    p, tail = float(threshold), 0.0
    for k in range(coordinates + 1):
        tail += math.comb(coordinates, k) * p ** k * (1 - p) ** (coordinates - k)
        if tail > miss:
            return max(k, 1)
    return coordinates


def multipliers(coordinates: int) -> np.ndarray:
    return (mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The shingle of each coordinate: the one with the lowest product, the first of ``s`` (sorted) where products are equal."""
    best = value = None
    for a in range(0, len(s), SPAN):
        part = s[a:a + SPAN]
        products = (part >> np.uint64(32)).astype(np.uint32) * by[:, None]
        at = products.argmin(axis=1)
        low = products[np.arange(len(by)), at]
        if best is None:
            best, value = low, part[at]
        else:
            less = low < best
            best, value = np.where(less, low, best), np.where(less, part[at], value)
    return value


def _rows(own: DataFrame, k: int, coordinates: int) -> DataFrame:
    """Size, node and signature of each row's set (node and signature null without shingles)."""

    def make():
        by = multipliers(coordinates)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text"), k)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([signature(s, by).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "h", "n", "node", "sig"])
        return run

    return emit(own, "text", "id bigint, h bigint, n bigint, node bigint, sig binary", make)


def _postings(nodes: DataFrame, coordinates: int) -> DataFrame:
    """``(key, node)``: one row for each coordinate of each node."""

    def run(batches):
        salt = mix(np.arange(1, coordinates + 1, dtype=np.uint64) << np.uint64(40))
        for batch in batches:
            if batch.num_rows:
                keys = mix(signatures(batch.column("sig"), coordinates) ^ salt)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)),
                                                  pa.array(np.repeat(batch.column("node").to_numpy(), coordinates))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def signatures(column: pa.Array, coordinates: int) -> np.ndarray:
    """A column of signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, coordinates)


def _prefixes(nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """``(key, node)``: the shortest lists of each node, so many that linked nodes share one."""
    postings = _postings(nodes, coordinates)
    length = released(postings.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = postings.join(length, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("lists"))
    shared = shared.filter(F.size("lists") >= least)
    return shared.select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (least - 1))).alias("x")).select("x.key", "node")


def may_link(a, b, threshold: Fraction):
    """Whether sets of these sizes may link."""
    return np.minimum(a, b) * threshold.denominator >= threshold.numerator * np.maximum(a, b)


def links(both, a, b, threshold: Fraction):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common shingles link."""
    return both * threshold.denominator >= threshold.numerator * (a + b - both)


def _counted(pairs: DataFrame, nodes: DataFrame, coordinates: int, least: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures agree often enough."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("xa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("xb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (signatures(batch.column("xa"), coordinates) == signatures(batch.column("xb"), coordinates)).sum(axis=1)
                good = pa.array((same >= least) & may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _texts(own: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, text)``: one text for each of the wanted nodes."""
    picked = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "h")).alias("x"))
    picked = picked.select("node", F.coalesce("x.id", F.lit(-1)).alias("i"), F.col("x.id").isNull().alias("none"), F.col("x.h").alias("h"))
    keyed = own.select(F.coalesce("id", F.lit(-1)).alias("i"), F.col("id").isNull().alias("none"), "h", "text")
    return keyed.join(picked, ["i", "none", "h"]).groupBy("node").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets link."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = zip(shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k), strict=True)
            good = pa.array([bool(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)) for x, y in sets], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])
        return run

    return emit(both, "ta", "a bigint, b bigint", make)


class Tile:
    """Nodes of a tile with their signatures and full sets."""

    def __init__(self, node, root, sig: np.ndarray, sets: list[np.ndarray]):
        self.node, self.root, self.sig = node, root, sig
        self.n = np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.n)
        _, self.shingle = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.shingle.max(initial=-1)) + 1, bool)

    def own(self, i: int) -> np.ndarray:
        return self.shingle[self.end[i] - self.n[i]:self.end[i]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Common shingles of set ``i`` and each of the others."""
        self.mark[self.own(i)] = True
        hits = self.mark[np.concatenate([self.own(j) for j in others.tolist()])]
        self.mark[self.own(i)] = False
        size = self.n[others]
        return np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)

    def joined(self, left: np.ndarray, right: np.ndarray, least: int, threshold: Fraction) -> list[tuple[int, int]]:
        """Links between ``left`` and ``right`` nodes of different components, so many as join all that have one."""
        onto: dict[int, int] = {}

        def find(x: int) -> int:
            while x in onto:
                x = onto[x]
            return x

        coordinates = self.sig.shape[1]
        order = np.argsort(self.sig[right], axis=0, kind="stable")
        low, high = np.empty((2, coordinates, len(left)), np.int64)
        for c in range(coordinates):
            line = self.sig[right[order[:, c]], c]
            low[c] = np.searchsorted(line, self.sig[left, c], side="left")
            high[c] = np.searchsorted(line, self.sig[left, c], side="right")
        found = []
        for at, i in enumerate(left.tolist()):
            # Merge all but the longest least - 1 lists; a node in those alone cannot have enough matches.
            lists = np.argsort(high[:, at] - low[:, at], kind="stable")[:coordinates - least + 1]
            held = np.concatenate([order[low[c, at]:high[c, at], c] for c in lists.tolist()])
            if not len(held):
                continue
            near = right[np.unique(held)]
            near = near[(self.root[near] != self.root[i]) & may_link(self.n[near], self.n[i], threshold)]
            near = near[(self.sig[near] == self.sig[i]).sum(axis=1) >= least]
            mine = find(int(self.root[i]))
            near = np.array([j for j in near.tolist() if find(int(self.root[j])) != mine], np.int64)
            if not len(near):
                continue
            for j in near[links(self.common(i, near), self.n[near], self.n[i], threshold)].tolist():
                x, y = find(int(self.root[i])), find(int(self.root[j]))
                if x != y:
                    onto[max(x, y)] = min(x, y)
                    found.append((int(self.node[i]), int(self.node[j])))
        return found


def _tiles(left: DataFrame, coordinates: int, least: int, threshold: Fraction) -> DataFrame:
    """Links (a, b) between components of a cluster. ``left``: (cluster, node, root, n, sig, s)."""

    def run(rows: pa.Table) -> pa.Table:
        node, root = (rows.column(c).to_numpy() for c in ("node", "root"))
        first, second = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        found = []
        if len(first) and len(second):
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
            found = Tile(node, root, signatures(rows.column("sig").combine_chunks(), coordinates), sets).joined(first, second, least, threshold)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    placed = tiles.dealt(left, "s", threshold)
    return placed.groupBy(*tiles.GROUP).applyInArrow(run, "a bigint, b bigint")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``(node, s)``: the sorted shingle hashes of each node, as bytes."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "s"])
        return run

    return emit(texts, "text", "node bigint, s binary", make)


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, *, k: int = SHINGLE, threshold: Fraction = THRESHOLD, coordinates: int = COORDINATES,
                    miss: float = MISS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z. Null, empty and wordless texts have no shingles and link with nothing: their
    component is their own id. A null id takes part in links, and the smallest id of its component that is not null is its component (null
    if there is none; it is then kept). Rows that repeat are in one component, and all that have its id are kept. Texts of any length
    are read whole; other columns are not read. An empty table gives no rows.
    """
    least = matches_needed(coordinates, threshold, miss)
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rows = released(_rows(own, k, coordinates))
    real = rows.filter("node IS NOT NULL")
    nodes = released(real.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    lists = released(_prefixes(nodes, coordinates, least))

    smallest = lists.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).filter("m > 1").select("key", "a")
    pairs = lists.join(smallest, "key").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    near = released(_counted(pairs, nodes, coordinates, least, threshold))
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = released(_confirmed(near, released(_texts(own, real, wanted)), k, threshold))

    # Lists whose sets are still in several components: clusters of them, by shared lists, are compared in tiles.
    held = released(_rooted(lists, found))
    apart = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"), F.min("node").alias("a"))
    left = released(held.join(apart.filter("x < y AND m > 2").select("key", "a"), "key").select("node", "root", "a").distinct())
    if not left.isEmpty():
        clusters = components(left.select("a", F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
        some = left.select("node", "root").distinct()
        sets = _sets(released(_texts(own, real, some)), k)
        tiled = some.join(clusters, "node").join(nodes.select("node", "n", "sig"), "node").join(sets, "node")
        found = released(found.union(_tiles(released(tiled), coordinates, least, threshold)))

    rooted = released(_rooted(nodes.select("node", "least"), found))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = released(rooted.join(component, "root").select("node", "component_id"))
    named = rows.select("id", "n", "node").join(component, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return named.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
