"""Merkle manifest of a dataset as a persistent tree with one version per tampered leaf.

A leaf is the digest of a row's fields. The leaves of a group ascend by id, and
level by level two neighbours become the digest of their hex digests (a last
single one becomes the digest of itself) until the group's subroot is left; the
subroots, ascending by group, make one more tree of the same kind.

Rows get their places by a range partition of (group, id): a group may hold any
share of the rows. Blocks of 2^BITS neighbours, aligned so that no subtree crosses
a border, are one row each, and a block's tree is built in one task. The blocks'
top nodes are the leaves of the next round, so that each round leaves one node in
2^BITS. On the way down every block learns the siblings above it and builds its
tree once more. A tampered leaf makes a version of this tree: the nodes that the
change does not touch are shared, and only its ancestors are copied, first inside
the block, then above it by the siblings that the block was handed, so that the
versions never meet in the task that holds the root.

Cases: a missing field is ``-``, an empty one ``0:``; missing ids come first and
have no version; a missing group is the first group; equal ids ascend by leaf, and
repeated rows are leaves of their own; texts of any length are hashed whole; an
empty table gives an empty manifest; other columns are not read. A version whose
leaf does not change (its count is missing) has the root of the untouched tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import name, parts, sized_broadcast

# Leaves of a block: 2 to this power.
BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def parent(node: str, sibling: str, left: bool) -> str:
    """The digest above a node; ``left`` tells that the sibling stands left of it, an empty sibling that it has none."""
    return digest(sibling + node if left else node + sibling)


def depth(size: int) -> int:
    """Levels above ``size`` nodes."""
    return max(size - 1, 0).bit_length()


class Tree:
    """Digests level by level. The tree itself never changes; versions hold the nodes in which they differ."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[k : k + 2])) for k in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, bool]]:
        """(sibling, is it left?) of the node at ``at`` and of its ancestors below the top."""
        out = []
        for level in self.levels[:-1]:
            other = at ^ 1
            out.append((level[other] if other < len(level) else "", other < at))
            at >>= 1
        return out

    def version(self, at: int, leaf: str) -> list[str]:
        """The ancestors that a changed leaf copies, bottom up; all other nodes are those of this tree."""
        return climb(leaf, self.siblings(at))


def climb(node: str, siblings: Iterable[tuple[str, bool]]) -> list[str]:
    """The nodes above a node, bottom up."""
    out = []
    for sibling, left in siblings:
        node = parent(node, sibling, left)
        out.append(node)
    return out


def field(c: Column) -> Column:
    """A value as byte count, colon and text; ``-`` if it is missing."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``pos``, from 0 up in the order within ``grp``, and ``size`` of the group, by a range partition.

    ``rows`` come from a written table, as a range partition samples what it deals.
    """
    keys = ["grp", *order, "_row"]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("grp")
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("grp", "_part", "_from", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("size"))
    runs = sized_broadcast(runs, F.octet_length("grp") + 40)
    df = placed.join(runs, ["grp", "_part"])
    return df.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_from", "_before")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes`` (grp, pos, size, key, node, changed): ``grp, block, size, items``."""
    block = F.shiftright("pos", BITS).alias("block")
    items = F.sort_array(F.collect_list(F.struct("pos", "key", "node", "changed")))
    return cut(nodes.groupBy("grp", block).agg(F.max("size").alias("size"), items.alias("items")))


TOPS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("key", pa.int64()), ("node", pa.string()), ("changed", pa.string())])


def _tree(items: list[dict], size: int) -> Tree:
    return Tree([x["node"] for x in items], min(BITS, depth(size)))


def _tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grp, block, size, items = (c.to_pylist() for c in b.columns)
        above = [-(-s // (1 << BITS)) for s in size]
        tops = [_tree(x, s).top for x, s in zip(items, size)]
        none = [None] * len(grp)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((grp, block, above, none, tops, none), TOPS.types)], schema=TOPS)


STEP = "array<struct<node:string,left:boolean>>"
STEPS = pa.list_(pa.struct([("node", pa.string()), ("left", pa.bool_())]))
PATHS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("key", pa.int64()), ("node", pa.string()), ("changed", pa.string()), ("path", STEPS), ("top", pa.string()), ("root", pa.string()), ("copies", pa.list_(pa.string()))])


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node with its siblings up to the top, and with what its version copies if the node is changed."""
    for b in batches:
        for grp, size, items, path, top, root in zip(*(c.to_pylist() for c in b.columns)):
            tree, above = _tree(items, size), [(s["node"], s["left"]) for s in path]
            out = []
            for at, x in enumerate(items):
                steps = tree.siblings(at) + above
                copies = None
                if x["changed"] is not None:
                    copies = tree.version(at, x["changed"])
                    copies += climb(copies[-1] if copies else x["changed"], above)
                out.append((grp, x["pos"], x["key"], x["node"], x["changed"], [{"node": s, "left": left} for s, left in steps], top, root, copies))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PATHS.types)], schema=PATHS)


def paths(nodes: DataFrame) -> DataFrame:
    """For each node of every group's tree: ``path``, the siblings up to the group's top, and ``top``.

    Round by round upwards while a group has several nodes, and back down.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    if largest <= 1:
        return nodes.select("grp", "pos", "key", "node", "changed", F.array().cast(STEP).alias("path"), F.col("node").alias("top"))
    held = blocks(nodes)
    above = paths(tops(held)).select("grp", F.col("pos").alias("block"), "path", "top", F.lit(None).cast("string").alias("root"))
    return down(held.join(above, ["grp", "block"]))


def tops(held: DataFrame) -> DataFrame:
    return held.mapInArrow(_tops, "grp string, pos long, size long, key long, node string, changed string")


def down(held: DataFrame) -> DataFrame:
    """The nodes of blocks that know the siblings above them."""
    schema = f"grp string, pos long, key long, node string, changed string, path {STEP}, top string, root string, copies array<string>"
    return held.select("grp", "size", "items", "path", "top", "root").mapInArrow(_paths, schema)


def manifest(docs: DataFrame, tampered: Column | None = None, doc_id: str = "doc_id", group: str = "lang", count: str = "n_chars", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per leaf: ``doc_id, leaf, subroot, root, path, tampered, copies, folded_root, verified``.

    ``path`` holds the siblings from the leaf to the root (an empty one where a node
    has none) with their side. Where ``tampered`` is true, a version of the tree adds
    one to ``count``; ``copies`` are the nodes it does not share, from the leaf's
    parent to its root. ``folded_root`` is the root of the leaf's version, or the root
    that the leaf and its path give; ``verified`` tells whether it is the true root.
    """
    spark = docs.sparkSession
    cols = {f: name(f) for f in fields}
    more = cols | {count: (cols[count].cast("decimal(20,0)") + 1)} if count in cols else cols
    hit = F.coalesce(tampered, F.lit(False)) & name(doc_id).isNotNull() if tampered is not None else F.lit(False)
    # A missing group sorts before every text.
    grp = F.coalesce(F.concat(F.lit("="), name(group).cast("string")), F.lit(""))
    rows = docs.select(
        grp.alias("grp"), name(doc_id).cast("long").alias("key"), leaf(cols.values()).alias("node"), F.when(hit, leaf(more.values())).alias("changed")
    )
    rows = cut(rows)
    n = parts(spark, 200 * rows.count())
    held = blocks(numbered(rows, ["key", "node"], n))
    above = cut(paths(tops(held)).select("grp", F.col("pos").alias("block"), "path", "top"))
    groups = above.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("node"))
    groups = cut(numbered(groups, ["name"], 1 + n // 64))
    empty = F.lit(None).cast("string")
    upper = paths(groups.select("grp", "pos", "size", F.lit(None).cast("long").alias("key"), "node", empty.alias("changed")))
    upper = groups.select("pos", "name").join(upper.select("pos", F.col("path").alias("upper"), F.col("top").alias("root")), "pos")
    upper = sized_broadcast(upper.select(F.col("name").alias("grp"), "upper", "root"), F.octet_length("grp") + 80 * F.size("upper") + 80)
    above = above.join(upper, "grp").select("grp", "block", F.concat("path", "upper").alias("path"), "top", "root")
    df = down(held.join(above, ["grp", "block"]))
    # An untouched leaf is folded along its path as well.
    folded = F.aggregate("path", F.col("node"), lambda x, s: F.sha2(F.when(s["left"], F.concat(s["node"], x)).otherwise(F.concat(x, s["node"])), 256))
    folded = F.when(F.col("copies").isNull(), folded).otherwise(F.coalesce(F.element_at("copies", -1), F.col("changed")))
    df = df.select(
        F.col("key").alias("doc_id"), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "path",
        F.col("changed").isNotNull().alias("tampered"), "copies", folded.alias("folded_root"),
    )
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, left to right and bottom up."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: s["node"])), 256)
