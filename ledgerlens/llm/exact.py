"""Exact dedup by Patricia-trie owners.

Texts are equal when their bytes are, after lower-casing A-Z. Each task first
puts its own texts into a compressed radix trie whose terminals hold the owner
id and a count, and so sends every distinct text once, however many copies it
has. The texts then meet by length and content hash, sorted by both, and a second
trie per (length, hash) run compares the full byte strings. A trie that outgrows
its memory bound spills by subtree: the largest subtrees give up their terminals
as partial owners, and the second step merges them.

Cases: a missing text counts as empty; missing ids never own a group that has an
id; of repeated rows with one id and text exactly one is kept; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import LOWER_BYTES, bounded_batches, name, parts, text_bytes

# Bytes of labels that a task's trie may hold before it spills.
TRIE_BYTES = 48 << 20


class Node:
    __slots__ = ("label", "children", "owner", "count")

    def __init__(self, label: bytes, owner: int | None = None, count: int = 0):
        self.label, self.children, self.owner, self.count = label, {}, owner, count


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed radix trie of byte strings; ``best`` picks the owner of two ids."""

    def __init__(self, best):
        self.best, self.root, self.bytes = best, Node(b""), 0

    def _own(self, node: Node, owner: int | None, count: int) -> None:
        ids = [x for x in (node.owner, owner) if x is not None]
        node.owner, node.count = (self.best(ids) if ids else None), node.count + count

    def add(self, data: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(data):
            child = node.children.get(data[at])
            if child is None:
                rest = data[at:]
                node.children[data[at]] = Node(rest, owner, count)
                self.bytes += len(rest) + 400
                return
            label = child.label
            if data[at : at + len(label)] == label:
                node, at = child, at + len(label)
                continue
            k = _shared(label, data[at : at + len(label)])
            middle = Node(label[:k])
            child.label = label[k:]
            middle.children[child.label[0]] = child
            node.children[data[at]] = middle
            self.bytes += 400
            node, at = middle, at + k
        self._own(node, owner, count)

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            n, before = stack.pop()
            data = before + n.label
            if n.count:
                yield data, n.owner, n.count
            stack.extend((c, data) for c in n.children.values())

    def spill(self, keep: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Terminals of the largest subtrees, removed until at most ``keep`` bytes stay."""
        size = {k: sum(len(n.label) + 400 for n in _walk(c)) for k, c in self.root.children.items()}
        for k in sorted(size, key=size.get, reverse=True):
            if self.bytes <= keep:
                return
            yield from self.terminals(self.root.children.pop(k))
            self.bytes -= size[k]


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(n.children.values())


def _normal(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES) if text else b""


PARTIAL = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("data", pa.binary()), ("owner", pa.int64()), ("count", pa.int64())])
OWNERS = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("owner", pa.int64()), ("count", pa.int64())])
MEMBERS = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string())])


def _rows(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``limit`` bytes of binary data, more or less."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _local(best):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(best)

        def row(t: tuple[bytes, int | None, int]) -> tuple:
            data, owner, count = t
            return len(data), xxhash.xxh3_64_intdigest(data) - (1 << 63), data, owner, count

        def spilled():
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    trie.add(_normal(text), i)
                if trie.bytes > TRIE_BYTES:
                    yield from map(row, trie.spill(TRIE_BYTES // 2))
            yield from map(row, trie.terminals())

        yield from _rows(spilled(), PARTIAL)

    return run


def _merge(best):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def owners():
            trie, key = Trie(best), None
            for b in batches:
                for n, h, data, owner, count in zip(*(c.to_pylist() for c in b.columns)):
                    if (n, h) != key:
                        yield from map(row, trie.terminals())
                        trie, key = Trie(best), (n, h)
                    trie.add(data, owner, count)
            yield from map(row, trie.terminals())

        def row(t: tuple[bytes, int | None, int]) -> tuple:
            return len(t[0]), hashlib.sha256(t[0]).hexdigest(), t[1], t[2]

        yield from _rows(owners(), OWNERS)

    return run


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_normal(t) for t in b.column(1).to_pylist()]
        sha = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha)], schema=MEMBERS)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says whether the smallest or the largest id of a group stays.
    """
    best = {"min": min, "max": max}[keep]
    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(name(doc_id).cast("long").alias("id"), name(text).alias("text"))
    # Written with a row number, so that one of several equal rows can be told from the rest.
    members = cut(
        rows.mapInArrow(_digest, "id long, n_bytes long, sha string").withColumn("row", F.monotonically_increasing_id())
    )
    n = parts(spark, text_bytes(docs, text))
    partial = rows.mapInArrow(_local(best), "n_bytes long, hash long, data binary, owner long, count long")
    owners = (
        partial.repartition(n, "n_bytes", "hash")
        .sortWithinPartitions("n_bytes", "hash")
        .mapInArrow(_merge(best), "n_bytes long, sha string, owner long, count long")
    )
    df = members.join(owners, ["n_bytes", "sha"])
    first = (
        df.where(F.col("id").eqNullSafe(F.col("owner")))
        .groupBy("n_bytes", "sha")
        .agg(F.min("row").alias("first"))
    )
    df = df.join(first, ["n_bytes", "sha"])
    return df.select(
        F.col("id").alias(doc_id),
        F.col("owner").alias("keep_id"),
        F.col("count").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
