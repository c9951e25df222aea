"""Merkle manifest of a table: a tree of SHA-256 midstates.

A leaf is the digest of a row's fields. The leaves of a part (a language) ascend by id, every ``FAN`` consecutive nodes become
the digest of their digests, until one is left; the parts' tops, by part, are raised in the same way to the root.

While a parent takes in its children, a copy of its hash state is retained before each child's slot. To fold a changed leaf,
the state before its slot is resumed with the replacement and the siblings to its right only; those to the left are
never hashed again. The result takes the next slot, up to the root.

Spark numbers the leaves (range partitions, an offset for each partition: no window over a part), and deals them in blocks of
``FAN ** LEVELS`` consecutive ones. A task raises one block at a time, and the tops of the blocks are the nodes of the next tier, so a
part of any size is blocks of equal size. On the way down each tier's table holds the siblings above each of its nodes,
and a block of leaves meets the one row of its own top: the states above the block are made once for all its leaves.

A digest is 64 hex digits, one block of SHA-256, so a retained state never holds an unfinished block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.stages import released

FAN = 8
LEVELS = 4
NODE = "part string, idx bigint, size bigint, digest string"
PATH = "path array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def part_of(c: Column) -> Column:
    """A key that is never null and sorts like ``c``, nulls first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their position in their ``part`` by ``order``, and ``size``, the number of the part's rows."""
    kept = rows.columns

    def run(batches):
        slot, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for part in batch.column("part").to_pylist():
                n = n + 1 if part == last else 0
                last = part
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([slot] * len(at), pa.int32()), pa.array(at, pa.int64())],
                                             names=[*kept, "slot", "nth"])

    spread = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = released(spread.mapInArrow(run, f"{fields}, slot int, nth bigint"))
    runs = placed.groupBy("part", "slot").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("part")  # over partitions, not rows
    runs = runs.select("part", "slot", F.sum("n").over(whole).alias("size"),
                       (F.sum("n").over(whole.orderBy("slot")) - F.col("n")).alias("start"))
    return placed.join(released(runs), ["part", "slot"]).select(*kept, (F.col("start") + F.col("nth")).alias("idx"), "size")


def height(size: int, levels: int) -> int:
    """Levels that a block of a part of ``size`` nodes is raised by."""
    up = 0
    while size > 1 and up < levels:
        size, up = -(-size // FAN), up + 1
    return up


class Block:
    """The levels over consecutive nodes, with the state of each parent before each child's slot."""

    def __init__(self, nodes: list[bytes], up: int):
        self.levels, self.states = [nodes], []
        for _ in range(up):
            parents, states = [], []
            for a in range(0, len(nodes), FAN):
                state = hashlib.sha256()
                for child in nodes[a:a + FAN]:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.states.append(states)
            self.levels.append(nodes := parents)
        self.sides = [[(b"".join(level[i - i % FAN:i]), b"".join(level[i + 1:i - i % FAN + FAN])) for i in range(len(level))]
                      for level in self.levels[:-1]]

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings to the left and to the right on each level over node ``at``."""
        return [sides[at // FAN ** k] for k, sides in enumerate(self.sides)]

    def fold(self, at: int, digest: bytes) -> bytes:
        """The block's top if node ``at`` were ``digest``."""
        for states, sides in zip(self.states, self.sides, strict=True):
            state = states[at].copy()
            state.update(digest + sides[at][1])
            digest, at = state.hexdigest().encode(), at // FAN
        return digest


def _block(rows: pa.Table, levels: int) -> tuple[pa.Table, Block]:
    rows = rows.sort_by("idx")
    digests = [d.encode() for d in rows.column("digest").to_pylist()]
    return rows, Block(digests, height(rows.column("size")[0].as_py(), levels))


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier: one node for each block of ``nodes``."""
    width = FAN ** levels

    def run(rows: pa.Table) -> pa.Table:
        rows, block = _block(rows, levels)
        size, up = rows.column("size")[0].as_py(), len(block.states)
        row = {"part": rows.column("part")[0].as_py(), "idx": rows.column("idx")[0].as_py() // width,
               "size": -(-size // FAN ** up), "digest": block.top.decode()}
        return pa.Table.from_pylist([row], schema=pa.schema(
            [("part", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))

    blocks = nodes.select("part", "idx", "size", "digest", F.floor(F.col("idx") / width).alias("block"))
    return released(blocks.groupBy("part", "block").applyInArrow(run, NODE))


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the tiers over them, up to one node for each part."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        out.append(raised(out[-1], levels))
    return out


def _met(nodes: DataFrame, above: DataFrame, levels: int, run, schema: str) -> DataFrame:
    """``run(rows, above)`` for each block of ``nodes`` and the row of its top in ``above``."""
    width = FAN ** levels
    blocks = nodes.withColumn("block", F.floor(F.col("idx") / width))
    tops = above.withColumnRenamed("idx", "block")
    return blocks.groupBy("part", "block").cogroup(tops.groupBy("part", "block")).applyInArrow(run, schema)


def lowered(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(part, idx, path, subroot, root)`` of a tier, by those of the tier above."""
    kind = pa.schema([("part", pa.string()), ("idx", pa.int64()),
                      ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                      ("subroot", pa.string()), ("root", pa.string())])

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kind.empty_table()
        rows, block = _block(rows, levels)
        over = {c: top.column(c)[0].as_py() for c in ("path", "subroot", "root")}
        ids = rows.column("idx").to_pylist()
        paths = [[{"before": a.decode(), "after": b.decode()} for a, b in block.path(i)] + over["path"] for i in range(len(ids))]
        return pa.Table.from_pydict({"part": rows.column("part").to_pylist(), "idx": ids, "path": paths,
                                     "subroot": [over["subroot"]] * len(ids), "root": [over["root"]] * len(ids)}, schema=kind)

    return released(_met(nodes, above, levels, run, f"part string, idx bigint, {PATH}, subroot string, root string"))


def descent(up: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """From the paths of the last tier (each part's top) to those of the second (the tops of the lowest blocks)."""
    for nodes in reversed(up[1:-1]):
        above = lowered(nodes, above, levels)
    return above


def folded(leaves: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root)`` of each leaf; ``changed`` replaces its digest if not null."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kind = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in names[1:]]])

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kind.empty_table()
        rows, block = _block(rows, levels)
        path = [(x["before"].encode(), x["after"].encode()) for x in top.column("path")[0].as_py()]
        states = [(hashlib.sha256(before), after) for before, after in path]
        siblings = b"".join(a + b for a, b in path)
        leaf, changed = rows.column("digest").to_pylist(), rows.column("changed").to_pylist()
        proofs, found = [], []
        for at, (own, other) in enumerate(zip(leaf, changed, strict=True)):
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in block.path(at)) + siblings).hexdigest())
            digest = block.fold(at, (other or own).encode())
            for state, after in states:
                state = state.copy()
                state.update(digest + after)
                digest = state.hexdigest().encode()
            found.append(digest.decode())
        same = {c: [top.column(c)[0].as_py()] * len(leaf) for c in ("subroot", "root")}
        return pa.Table.from_pydict({"id": rows.column("id").cast(pa.int64()), "leaf": leaf, **same, "proof_sha256": proofs,
                                     "folded_root": found}, schema=kind)

    schema = "id bigint, " + ", ".join(f"{c} string" for c in names[1:])
    return _met(leaves, above, levels, run, schema)


def verify(docs: DataFrame, columns: list[str], *, part: str = "lang", id: str = "doc_id", changed: Column | None = None,
           changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row of ``docs``.

    ``columns`` make up a leaf, in order. Rows for which ``changed`` holds are folded as if ``changes`` (column to expression)
    had been made since; the others are folded with their own leaf. ``verified`` tells whether that gives the root.

    Null fields are ``-``, empty ones ``0:``. A null id sorts first, and a null part is a part of its own, the first. Rows
    of one id are in the order of their digests, so rows that repeat are leaves of their own, next to each other. A part of one
    row is its own top, and a table of one part has that part's top as its root: a lone row is the root, its proof the
    digest of nothing. An empty table gives no rows. Texts are hashed whole by the JVM, whatever their length; other columns are not read.
    """
    fields = [F.col(c) for c in columns]
    later = [(changes or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(part_of(F.col(part)).alias("part"), F.col(id).cast("bigint").alias("id"), leaf(fields).alias("digest"),
                       F.when(F.lit(False) if changed is None else changed, leaf(later)).alias("changed"),
                       F.monotonically_increasing_id().alias("row"))
    leaves = numbered(released(rows), ["id", "digest", "row"]).drop("row")
    up = tiers(leaves, levels)
    tops = up[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "digest")
    tops = released(numbered(tops, ["name"]))
    over = tiers(tops, levels)
    crown = over[-1].select("part", F.lit(0).cast("bigint").alias("idx"), F.expr("CAST(array() AS array<struct<before:string,after:string>>)").alias("path"),
                            F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = lowered(tops, descent(over, crown, levels), levels)
    named = tops.select("part", "idx", F.col("name"), F.col("digest").alias("own"))
    above = paths.join(named, ["part", "idx"]).select(F.col("name").alias("part"), F.lit(0).cast("bigint").alias("idx"), "path",
                                                      F.col("own").alias("subroot"), "root")
    found = folded(leaves, descent(up, released(above), levels), levels)
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id)
