"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct ``k``-word shingles. Sets are compared in bands of sizes. In each band the
shingles are dealt by hash to parts, and each part is the XOR of the hashes of its shingles. A shingle that only one of two
sets holds changes one part, and the threshold bounds the symmetric difference by D; of a set's parts that are not empty all but D are
therefore equal in any set that it links with, and linked sets share the keys (band, part, bits) of these. A set with no more than D such
parts also offers its D + 1 smallest hashes, one of which any other such set that links with it offers too.

What a set shares beyond the one key that a link needs is its room, and so many keys may go unused in an order that all sets agree on. Those beyond
``Bands.held`` are left out as they are made, by their value. Of the keys that other sets have too, as many as the room left are then dropped, the most
frequent first: a passage that many texts hold makes long lists of a few parts each, and texts that share nothing else meet in none of them. A set with
no more shared keys than room links with nothing.

A second sketch has parity bits, four times as many as the set has shingles: the Hamming distance of two
of them is at most the symmetric difference, so pairs further apart than D are dropped before any text is fetched.

Within a key every set is compared with the smallest id only, on the shingle hashes of the two texts. Then the other sets of a key that
are still in different components are gathered to clusters by shared keys of one band, and the sets of a cluster are compared in
tiles, by Hamming distance first, where their sizes allow a link. A tile returns only links that join components. So a group of n near copies costs n
comparisons as a rule, links inside a found component are not listed, and no link between components is lost. Only sketches are dealt to the
tiles at first; the shingles of a set follow if its sketch may link with that of another component.

Equal sets are one node (its id: a 64-bit hash of the set), so exact copies cost one row per key and batch.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm import tiles
from sojourn.llm.stages import discard, released, sweep
from sojourn.llm.words import SPACED, bounds, emit, lower_ascii, mix, ngram_hashes, raw, word_hashes
from sojourn.operators.staging import staged

SHINGLE = 4
THRESHOLD = Fraction(85, 100)
#: Ratio of neighbouring band limits.
BAND = 1.25
#: The low bits of a key are its band.
BAND_BITS = 8
TILE_WORDS = 64
#: Tasks that share a hub of the components' graph.
SPREAD = 16


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where there are fewer than ``k`` words."""
    data, offsets = raw(texts)
    data = lower_ascii(data)
    starts, ends, first = bounds(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    full = ngram_hashes(hashes, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(full[a:b - k + 1]))
        elif b > a:
            sets.append(ngram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def node_of(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].view(np.int64))


class Bands:
    """Which layouts a set of a given size belongs to, and their numbers of parts."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.limits = [1]
        while self.limits[-1] < 1 << 62:
            self.limits.append(max(self.limits[-1] + 1, int(self.limits[-1] * BAND)))
        self.tops = [self.apart(x - 1) for x in self.limits[1:]]

    def apart(self, n: int) -> int:
        """Largest symmetric difference of a set of size ``n`` and a set at least as large that links with it."""
        return (self.t.denominator - self.t.numerator) * n // self.t.numerator

    def bounds(self, n: int) -> list[int]:
        """Bands b (sizes limits[b] to limits[b + 1] - 1 of the smaller set) in which a set of size ``n`` may take part."""
        top = int(np.searchsorted(self.limits, n, side="right")) - 1
        out = [top]
        while out[-1] > 0 and (self.limits[out[-1]] - 1) >= self.t * n:
            out.append(out[-1] - 1)
        return out

    def most(self, band: int) -> int:
        """Largest symmetric difference of linked sets, the smaller of which lies in the band."""
        return self.tops[band]

    def differ(self, n: int, band: int) -> int:
        """Largest symmetric difference of a set of size ``n`` in the band and one that it links with there."""
        return min(self.most(band), self.apart(n))

    def held(self, band: int) -> int:
        """So much room is kept for the keys that turn out to be frequent."""
        return self.most(band) // 6 + 4

    def check_words(self, band: int) -> int:
        """Four positions for each shingle: then few shingles cancel out, and the distance is close to the difference."""
        return (4 * self.limits[band + 1] + 63) // 64

    def parts(self, band: int) -> int:
        return self.most(band) + self.most(band) // 4 + 5

    def dealt(self, s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Part of each hash of a set (sorted; parts are ranges of hashes), where the parts begin, and the room: below 0 without a common part for sure."""
        part = ((s >> np.uint64(32)) * np.uint64(self.parts(band))) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return part, begin, len(begin) - self.differ(len(s), band) - 1

    def room(self, s: np.ndarray, band: int) -> int:
        """Of its keys that other sets have too a set keeps one more at least than so many in common with each set that it links with."""
        return min(max(self.dealt(s, band)[2], 0), self.held(band))

    def keys(self, s: np.ndarray, band: int) -> np.ndarray:
        """Hashes of the parts that are not empty, without those that the room allows beyond ``held``."""
        part, begin, room = self.dealt(s, band)
        differ = self.differ(len(s), band)
        keys = mix(np.bitwise_xor.reduceat(mix(s), begin) ^ mix(part[begin] + np.uint64(band << 40)))
        if room < 0:
            keys = np.concatenate([keys, mix(s[:differ + 1] ^ mix(np.uint64([(band << 40) + (1 << 39)])))])
        elif room > self.held(band):
            keys = np.sort(keys)[:differ + 1 + self.held(band)]
        return (keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band)


def jaccard_links(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * threshold.denominator >= threshold.numerator * (len(a) + len(b) - both)


def check_bits(s: np.ndarray, words: int) -> np.ndarray:
    """A short sketch of the whole set, to tell unrelated sets apart before texts are fetched."""
    out = np.zeros(words, dtype=np.uint64)
    if len(s):
        h = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        odd = np.bincount((((h >> np.uint64(32)) * np.uint64(words * 64)) >> np.uint64(32)).astype(np.int64), minlength=words * 64) & 1
        out = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def near_enough(apart, a, b, threshold: Fraction):
    """Whether sets of sizes ``a`` and ``b`` with sketches so far apart may link."""
    up, down = threshold.numerator, threshold.denominator
    return (apart * (up + down) <= (down - up) * (a + b)) & (np.minimum(a, b) * down >= up * np.maximum(a, b))


def _nodes(own: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Size, node, and check sketches and rooms (one for each band) of each row's set."""
    bands = Bands(threshold)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text"), k)
            places = [bands.bounds(len(s)) if len(s) else [] for s in sets]
            bits = [[{"band": b, "bits": check_bits(s, bands.check_words(b)).tobytes()} for b in at] for s, at in zip(sets, places, strict=True)]
            rooms = [[{"band": b, "room": bands.room(s, b)} for b in at] for s, at in zip(sets, places, strict=True)]
            kinds = [pa.list_(pa.struct([("band", pa.int32()), x])) for x in (("bits", pa.binary()), ("room", pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), batch.column("h"),
                 pa.array(bits, kinds[0]), pa.array(rooms, kinds[1])], names=["id", "n", "node", "h", "bits", "rooms"])
        return run

    return emit(own, "text", "id bigint, n bigint, node bigint, h bigint, bits array<struct<band:int,bits:binary>>, "
                "rooms array<struct<band:int,room:int>>", make)


def _keys(own: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    bands = Bands(threshold)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, nodes, seen = [], [], set()
            for s in shingle_sets(batch.column("text"), k):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                for band in bands.bounds(len(s)):
                    keys.append(bands.keys(s, band))
                    nodes.append(np.full(len(keys[-1]), node))
            if not keys:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])
        return run

    return emit(own, "text", "key bigint, node bigint", make)


def _band(key: str = "key"):
    return F.col(key).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def _members(keys: DataFrame) -> DataFrame:
    """``(key, node, pivot)``: the sets that share a key with a smaller one, and the smallest of the key.

    Rows come sorted, so a key streams through its task in constant memory, however many sets share it.
    """

    def run(batches):
        last_key = last_node = pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            first = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            again = np.r_[not first[0] and node[0] == last_node, ~first[1:] & (node[1:] == node[:-1])]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            least = np.where(begin >= 0, node[begin], 0 if pivot is None else pivot)
            take = pa.array(~first & ~again)
            last_key, last_node, pivot = key[-1], node[-1], least[-1]
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(take), batch.column("node").filter(take), pa.array(least).filter(take)],
                                             names=["key", "node", "pivot"])

    dealt = keys.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key bigint, node bigint, pivot bigint")


def _lists(members: DataFrame, rooms: DataFrame) -> DataFrame:
    """``(key, node)``: the shared keys of each set but for the most frequent ones, as many as its room. ``rooms``: (node, band, room)."""
    length = members.groupBy("key").agg((F.count("*") + 1).alias("m"), F.min("pivot").alias("pivot"))
    every = members.select("key", "node").union(length.select("key", F.col("pivot").alias("node")))
    held = every.join(length.select("key", "m"), "key").withColumn("band", _band()).join(rooms, ["node", "band"])
    own = Window.partitionBy("node", "band")
    ranked = held.select("key", "node", "room", F.row_number().over(own.orderBy("m", "key")).alias("at"), F.count("*").over(own).alias("of"))
    return ranked.filter("at <= of - room").select("key", "node")


def _near(pairs: DataFrame, bits: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of nodes of one band whose check sketches allow a link."""
    x = bits.select(F.col("node").alias("a"), "band", F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = bits.select(F.col("node").alias("b"), "band", F.col("n").alias("nb"), F.col("bits").alias("xb"))
    both = pairs.join(x, ["a", "band"]).join(y, ["b", "band"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # Both sketches of a pair are of one band and so of one length.
            words = pc.binary_length(batch.column("xa")).to_numpy().astype(np.int64) // 8
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("xa", "xb"))
            apart = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), np.cumsum(words) - words)
            good = pa.array(near_enough(apart, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a bigint, b bigint").distinct()


def _texts(own: DataFrame, real: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, text)``: one text for each node of the pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    picked = real.groupBy("node").agg(F.min(F.struct("id", "h")).alias("x")).join(wanted, "node", "left_semi")
    picked = picked.select("node", F.coalesce("x.id", F.lit(-1)).alias("k"), F.col("x.id").isNull().alias("none"), F.col("x.h").alias("h"))
    keyed = own.select(F.coalesce("id", F.lit(-1)).alias("k"), F.col("id").isNull().alias("none"), "h", "text")
    # Rows that repeat meet where the join has put them, so that texts are dealt once.
    return keyed.join(picked, ["k", "none", "h"]).groupBy("k", "none", "h", "node").agg(F.first("text").alias("text")).select("node", "text")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link. ``texts``: (node, text)."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = pa.array([jaccard_links(x, y, threshold) for x, y in zip(
                shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k), strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])
        return run

    return emit(both, "ta", "a bigint, b bigint", make)


def may_meet(i: int, n: np.ndarray, roots: np.ndarray, origin: np.ndarray, bits: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Those ``right`` nodes of another component in the cluster of node ``i`` whose sketches allow a link with it."""
    at = right[(roots[right] != roots[i]) & (origin[right] == origin[i]) & near_enough(0, n[right], n[i], threshold)]
    return at[near_enough(np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1).astype(np.int64), n[at], n[i], threshold)]


def compared(nodes: np.ndarray, roots: np.ndarray, origin: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
             threshold: Fraction) -> list[tuple[int, int]]:
    """Links between sets of different components, so many as join all components that have one."""
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    n = np.array([len(s) for s in sets], dtype=np.int64)
    bits = np.stack([check_bits(s, TILE_WORDS) for s in sets])
    found = []
    for i in left.tolist():
        for j in may_meet(i, n, roots, origin, bits, right, threshold).tolist():
            x, y = find(int(roots[i])), find(int(roots[j]))
            if x != y and jaccard_links(sets[i], sets[j], threshold):
                joined[max(x, y)] = min(x, y)
                found.append((int(nodes[i]), int(nodes[j])))
    return found


def _sides(rows: pa.Table) -> tuple:
    node, root, origin = (rows.column(c).to_numpy() for c in ("node", "root", "origin"))
    first, second = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    return node, root, origin, first, second


def _candidates(left: DataFrame, threshold: Fraction) -> DataFrame:
    """``(cluster, node)``: the nodes of which some sketch of another component allows a link. ``left``: (cluster, node, root, n, bits)."""

    def run(rows: pa.Table) -> pa.Table:
        place = rows.column("origin").to_numpy()
        order = np.argsort(place, kind="stable")
        found = []
        # Sketches are of one length within a cluster only.
        for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            part = rows.take(pa.array(at))
            node, root, origin, first, second = _sides(part)
            n = part.column("n").to_numpy()
            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
            seen = np.zeros(len(n), bool)
            for i in first.tolist():
                near = may_meet(i, n, root, origin, bits, second, threshold)
                if len(near):
                    seen[i] = seen[near] = True
            found.append((origin[seen], node[seen]))
        return pa.table({c: pa.array(np.concatenate([x[i] for x in found])) for i, c in enumerate(("cluster", "node"))})

    return tiles.dealt(left, "bits", threshold).groupBy(*tiles.GROUP).applyInArrow(run, "cluster bigint, node bigint").distinct()


def _tiles(left: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) between components of a cluster. ``left``: (cluster, node, root, n, s)."""

    def run(rows: pa.Table) -> pa.Table:
        node, root, origin, first, second = _sides(rows)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
        found = compared(node, root, origin, sets, first, second, threshold)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    return tiles.dealt(left, "s", threshold).groupBy(*tiles.GROUP).applyInArrow(run, "a bigint, b bigint")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``(node, s)``: the sorted shingle hashes of each node, as bytes."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "s"])
        return run

    return emit(texts, "text", "node bigint, s binary", make)


def _least(rows: DataFrame) -> DataFrame:
    """``(u, v)`` rows with ``m``, the smallest ``v`` of each ``u``. A hub's rows are spread over ``SPREAD`` tasks, and only its partial results meet."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)))
    parts = rows.groupBy("u", "part").agg(F.min("v").alias("m"))
    parts = parts.select("u", "part", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return rows.join(parts, ["u", "part"]).drop("part")


def _stars(edges: DataFrame) -> bool:
    """True when every node points to one root and no root points anywhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``: each linked node and the smallest node of its component, by large-star and small-star steps in turn."""
    edges = staged(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = _least(edges.union(edges.select("v", "u")))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()
        down = _least(large)
        edges = staged(down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        sweep(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component (themselves without links)."""
    return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, *, k: int = SHINGLE, threshold: Fraction = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, text_hash)``, one row for each row of ``docs``.

    Words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z. Null, empty and wordless texts have no shingles and link with nothing:
    their component is their own id. A null id takes part in links, and the smallest id of its component that is not null is its
    component (null if there is none). Rows that repeat are in one component. Other columns are not read.
    """
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    nodes = released(_nodes(own, k, threshold))
    real = nodes.filter("node IS NOT NULL").select("id", "n", "node", "h")
    members = released(_members(_keys(own.filter("text IS NOT NULL"), k, threshold)))
    rooms = nodes.filter("node IS NOT NULL").select("node", F.explode("rooms").alias("x")).select("node", "x.band", "x.room").distinct()
    lists = released(_lists(members, rooms))
    discard(members)
    smallest = lists.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).filter("m > 1").select("key", "pivot")
    others = released(lists.join(smallest, "key").filter("node > pivot").select("key", "node", "pivot", _band().alias("band")))
    discard(lists)

    pairs = released(others.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "band").distinct())
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Copies are one row before they are dealt.
    bits = nodes.filter("node IS NOT NULL").select("node", "n", "bits").dropDuplicates(["node"]).join(some, "node", "left_semi")
    bits = released(bits.select("node", "n", F.explode("bits").alias("x")).select("node", "n", "x.band", "x.bits"))
    near = released(_near(pairs, bits, threshold))
    texts = released(_texts(own, real, pairs))
    links = released(_verified(near, texts, k, threshold))
    discard(near)

    # Keys of which the sets besides the smallest are in several components: clusters of these, by shared keys of one band, are compared in tiles.
    rooted = others.join(released(_rooted(some, links)), "node")
    apart = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("least")).filter("x < y").select("key", "least")
    left = rooted.join(apart, "key").select("node", "root", "band", *[F.xxhash64(c, "band").alias(x) for c, x in (("least", "a"), ("node", "b"))])
    left = released(left.distinct())
    discard(others, pairs)
    if not left.isEmpty():
        clusters = components(left.select("a", "b")).select(F.col("node").alias("b"), F.col("root").alias("cluster"))
        sized = left.select("node", "root", "band", "b").distinct().join(clusters, "b").join(bits, ["node", "band"])
        sized = released(sized.select(F.xxhash64("cluster", "band").alias("cluster"), "node", "root", "n", "bits"))
        met = released(_candidates(sized, threshold))
        sets = _sets(texts.join(met.select("node").distinct(), "node", "left_semi"), k)
        more = released(_tiles(released(sized.drop("bits").join(met, ["cluster", "node"]).join(sets, "node")), threshold))
        links = released(links.union(more))
    discard(texts, bits)

    # Per node first, so that only the last join meets all rows of a group of copies, and its other side is a written table.
    rooted = released(_rooted(real.groupBy("node").agg(F.min("id").alias("least")), links))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = released(rooted.join(component, "root").select("node", "component_id"))
    named = nodes.join(component, "node", "left")
    return named.select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "id").alias("component_id"), F.col("h").alias("text_hash"))


def one_of_each(docs: DataFrame, *, k: int = 5, threshold: Fraction = Fraction(80, 100), id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns kept, whatever their names.

    Rows that repeat (equal ids and texts) are one document; which of them stays, if other columns differ, is the first by all columns.
    Texts without words stay, and so do rows with a null id that are linked to no other id. An empty table gives no rows.
    """
    found = groups(docs, k=k, threshold=threshold, id=id, text=text)
    keep = found.filter(F.col(id).eqNullSafe(F.col("component_id")))
    key = [F.coalesce(F.col(id).cast("bigint"), F.lit(-1)).alias("i"), F.col(id).isNull().alias("none")]
    keep = keep.select(*key, F.col("text_hash").alias("h")).distinct()
    marked = docs.select(*key, F.xxhash64(text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = marked.join(keep, ["i", "none", "h"], "left_semi").groupBy("i", "none", "h").agg(F.min("row").alias("row"))
    return kept.select("row.*")
