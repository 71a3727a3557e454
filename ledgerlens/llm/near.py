"""MinHash near-dedup: banded minima, checked on full shingle sets, and connected components.

1. A document's set is its distinct word shingles, as 64-bit hashes. Equal sets
   are one class. A class has 128 minima under universal hash functions, cut into
   32 bands of 4; a pair at similarity 0.8 shares a band but for 5 in 10^8 cases.
2. In each bucket of a band the best connected member is the pivot, and only
   (pivot, member) pairs are made. Those whose minima agree are confirmed on the
   full sets, and the links settle into components.
3. A bucket that still holds several components can hide links between members
   other than the pivot. There, members outside the bucket's largest component are
   compared with the members of other components inside tasks of bounded blocks, by
   their minima and by counts of their shingles in 512 cells (the sum of the smaller
   counts bounds the common shingles from above). Only pairs that can still reach
   the threshold leave the task; they are confirmed on the full sets like the others.

So a component is linked exactly as all pairs in all buckets would link it, and no
step writes the pairs of a group.

Cases: documents without words link with nothing; fewer words than a shingle make
one shingle of all; a component's id is its smallest document id, missing ids
aside (missing if all are); of repeated rows with that id one is kept; texts of any
length have their whole set, with minima in blocks of bounded memory; an empty
table gives an empty result. Only id and text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attach import attach, group_size
from ..session import cut
from .common import bounded_batches, lower_words, name, release, sized_broadcast
from .components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
CELLS = 512
# Minima of a pair must agree in this share; at a similarity of 0.8 the share is below in one case of 10^7.
AGREE = 0.61
# Members of a bucket that one task compares.
BLOCK = 2048

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word to 64-bit hash; forgotten when it grows beyond 100,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M2
    return z ^ (z >> np.uint64(31))


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; all words as one if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    z = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        z = _mix(z * _M1 + h[k : k + n])
    return np.unique(z)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima (upper 32 bits) of each non-empty set, in blocks of bounded memory."""
    out = np.empty((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 1 << 19):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.cumsum([0, *map(len, sets[start : stop - 1])])
        for k in range(HASHES):
            out[start:stop, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], at) >> np.uint64(32)
        start = stop
    return out


def cells(s: np.ndarray) -> np.ndarray:
    """Shingles per cell, at most 65535 in one (beyond that the bound of a pair is void)."""
    n = np.bincount((s >> np.uint64(9)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(n, 65535).astype(np.uint16)


FEATURES = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])


def _features(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(lower_words(t), width, hashes) for t in b.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(minima(full)) if full else iter(())
            set_key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [next(sig).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_key, pa.binary()), pa.array(sigs, pa.binary())],
                schema=FEATURES,
            )

    return run


def _sets(width: int):
    schema = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen: dict[bytes, None] = {}
        for b in batches:
            out: dict[bytes, bytes] = {}
            for t in b.column(0).to_pylist():
                s = shingle_set(lower_words(t), width, hashes).tobytes()
                key = xxhash.xxh3_128_digest(s)
                if key not in seen:
                    seen[key], out[key] = None, s
            # A task sends copies of a set once, as far back as it remembers.
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], schema=schema)

    return run


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cell counts of full sets."""
    schema = pa.schema([("uid", pa.int64()), ("cells", pa.binary())])
    for b in batches:
        counts = [cells(np.frombuffer(s, np.uint64)).tobytes() for s in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.binary())], schema=schema)


def _agree(percent: int):
    """(a, b) of those pairs whose minima agree well enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = AGREE * percent / 80
        for t in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, HASHES) for c in t.columns[2:4])
            ok = pa.array((x == y).mean(axis=1) >= bound)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], schema=schema)

    return run


def _confirm(percent: int):
    """(a, b) of those pairs whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], schema=schema)

    return run


def _cross(percent: int):
    """Pairs of one block of a bucket that may be similar: members outside the largest component against the others."""

    def run(table: pa.Table) -> pa.Table:
        uid = table["uid"].to_numpy()
        root = table["root"].to_numpy()
        size = table["n"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        cell = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint16).reshape(-1, CELLS).astype(np.int32)
        left = np.flatnonzero(table["left"].to_numpy(zero_copy_only=False))
        right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        main = table["outside"].to_numpy(zero_copy_only=False)
        void = (cell >= 65535).any(axis=1)
        bound = AGREE * percent / 80
        pairs: list[tuple[int, int]] = []
        for i in left:
            # Of two members outside, the one with the smaller number looks at the other.
            j = right[(root[right] != root[i]) & (~main[right] | (uid[right] > uid[i]))]
            j = j[(100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            j = j[(sig[j] == sig[i]).mean(axis=1) >= bound]
            if len(j):
                most = np.minimum(cell[j], cell[i]).sum(axis=1)
                j = j[void[j] | void[i] | (100 * most >= percent * (size[j] + size[i] - most))]
                pairs += [(min(uid[i], x), max(uid[i], x)) for x in uid[j]]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _band_keys(sig: str):
    """One 64-bit key per band of a signature."""
    width = 4 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col(sig), b * width + 1, F.lit(width))))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and the row's digest ``key`` (xxhash64 of the text).

    ``width``: words of a shingle; ``percent``: 100 times the least similarity of a link.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(name(doc_id).cast("long").alias("id"), F.xxhash64(name(text)).alias("key"), name(text).alias("text"))
    spec = "id long, key long, n long, set_key binary, sig binary"
    found = cut(rows.mapInArrow(_features(width), spec).withColumn("uid", F.monotonically_increasing_id()))

    # Classes of equal sets, each under the smallest row number of its members.
    classes = found.where("n > 0").groupBy("set_key").agg(F.min("uid").alias("rep"), group_size())
    reps = found.select("uid", "key", "n", "sig").join(classes.select(F.col("rep").alias("uid")), "uid")
    entries = reps.select("uid", F.explode(_band_keys("sig")).alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = cut(entries.join(sized_broadcast(crowded, F.lit(24)), "bucket"))
    degree = entries.groupBy("uid").agg(F.sum("m").alias("degree"))

    # Full sets of the classes that share a bucket with another one; their texts are found by digest.
    near = cut(reps.join(degree, "uid"))
    wanted = sized_broadcast(near.select("key").distinct(), F.lit(16))
    texts = rows.where("text IS NOT NULL").join(wanted, "key", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "set_key binary, shingles binary")
    named = classes.select("set_key", "rep").join(near.select(F.col("uid").alias("rep")), "rep")
    # Copies of a wanted text give the same set again; the first is enough.
    sets = cut(sets.join(named, "set_key").groupBy("rep").agg(F.min("shingles").alias("shingles")))

    def with_both(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
        one = table.select(F.col(key).alias("a"), F.col(value).alias("x"))
        two = table.select(F.col(key).alias("b"), F.col(value).alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return with_both(pairs, sets, "rep", "shingles").mapInArrow(_confirm(percent), "a long, b long")

    ranked = entries.join(degree, "uid")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("uid")).alias("u"))).alias("best")).select("bucket", (-F.col("best.u")).alias("pivot"))
    stars = (
        entries.join(sized_broadcast(pivots, F.lit(24)), "bucket")
        .where("uid <> pivot")
        .select(F.least("uid", "pivot").alias("a"), F.greatest("uid", "pivot").alias("b"))
        .distinct()
    )
    stars = with_both(stars, near, "uid", "sig").mapInArrow(_agree(percent), "a long, b long")
    links = cut(confirmed(stars))
    del stars
    release(spark)
    roots = cut(components(links))
    release(spark)

    # Buckets that still hold several components, and whose members were not all compared with the pivot.
    placed = entries.where("m > 2").join(roots, F.col("uid") == F.col("node"), "left")
    placed = placed.select("bucket", "uid", "m", F.coalesce("root", "uid").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    mixed = mixed.where("kinds > 1").select("bucket", F.col("top.root").alias("main"))
    placed = placed.join(sized_broadcast(mixed, F.lit(24)), "bucket").withColumn("outside", F.col("root") != F.col("main"))
    # A block task holds a slice of the members outside (left) and a slice of all members (right).
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.hash("uid"), blocks)
    placed = placed.withColumns({"blocks": blocks, "mine": mine})
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_right = placed.select("*", F.explode(every).alias("i"), F.col("mine").alias("j"))
    as_left = placed.where("outside").select("*", F.col("mine").alias("i"), F.explode(every).alias("j"))
    tasks = (
        as_left.select("bucket", "i", "j", "uid", "root", "outside", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .union(as_right.select("bucket", "i", "j", "uid", "root", "outside", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("bucket", "i", "j", "uid", "root", "outside")
        .agg((F.max("l") > 0).alias("left"), (F.max("r") > 0).alias("right"))
    )
    # Only members of such buckets need their cells.
    counted = sets.join(placed.select(F.col("uid").alias("rep")).distinct(), "rep").select("rep", "shingles")
    counted = counted.mapInArrow(_cells, "uid long, cells binary")
    payload = tasks.join(near.select("uid", "n", "sig").join(counted, "uid"), "uid")
    cross = payload.groupBy("bucket", "i", "j").applyInArrow(_cross(percent), "a long, b long").distinct()
    cross = cut(cross)
    release(spark)
    more = cut(confirmed(cross))
    release(spark)
    roots = cut(components(links.union(more)))
    release(spark)

    # Row -> class -> component; the smallest document id names a component.
    # Classes and components can be large, so both meet their rows by the skew-proof join.
    df = attach(found.select("uid", "id", "key", "n", "set_key"), classes, ["set_key"]).withColumn("rep", F.coalesce("rep", "uid"))
    df = df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    df = cut(df.select("uid", "id", "key", "n", "root"))
    best = df.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best"), group_size())
    df = attach(df, best, ["root"])
    return df.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.col("best.id").alias("component_id"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "key",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one document of each component: the one with the smallest id."""
    rows = near_groups(docs, doc_id, text, width, percent)
    rows = cut(rows.select(F.col(doc_id).alias("_of"), F.col("key").alias("_key"), "kept"))
    kept = rows.groupBy("_of", "_key").agg(F.max(F.col("kept").cast("int")).alias("any"), F.count(F.lit(1)).alias("_rows"))
    kept = sized_broadcast(kept.where("any = 1").select("_of", "_key", "_rows"), F.lit(40))
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    df = docs.select(name(doc_id).alias("_id"), name(text).alias("_text"), F.struct(F.lit(0), *map(name, rest)).alias("_rest"))
    on = F.col("_id").cast("long").eqNullSafe(F.col("_of")) & F.xxhash64("_text").eqNullSafe(F.col("_key"))
    df = df.join(kept, on)
    # A row that is there several times stays once.
    df = df.where("_rows = 1").union(df.where("_rows > 1").dropDuplicates(["_of", "_key"]))
    back = {doc_id: F.col("_id"), text: F.col("_text")}
    return df.select(*((back[c] if c in back else F.col("_rest").getField(c)).alias(c) for c in docs.columns))
