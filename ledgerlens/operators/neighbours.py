"""Exact nearest-neighbour regression by pivot cells.

Points are assigned to their nearest pivot. Cell sizes and radii, one row per
pivot, bound each query's k-th distance, and the triangle inequality then names
the cells that can hold a neighbour. Queries go to blocks of bounded size by their
own cell; points are packed by cell. A block holds its queries and their k best so far
and reads the packs of its cells one after the other. Matrix
products rule out the points beyond a query's k-th distance, with a margin for
rounding; the others are measured coordinate by coordinate. So a block leaves k rows
a query, however many points it has read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut
from .sampling import hash_int

BLOCK_ROWS = 16_384
# Neighbours that a block holds, distances that it works out at a time, and found neighbours that it sorts at a time.
HELD, AT_ONCE, SORTED = 6_000_000, 1 << 20, 1 << 19
# Points of a pack. Coordinates that a block meets at a time.
PACK = 4096
MET = 1 << 20


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j : j + 1] - b[:, j]
        out += d * d
    return np.sqrt(out)


def _matrix(s) -> np.ndarray:
    return np.array([np.asarray(v, dtype="float64") for v in s], dtype="float64").reshape(len(s), -1)


def choose_pivots(points: DataFrame, id_col: str, vec: str, n: int) -> np.ndarray:
    """The n points that come first in hash order."""
    rows = points.select(vec, hash_int(id_col, 17).alias("_h"), id_col).orderBy("_h", id_col).limit(n).collect()
    return _matrix([r[vec] for r in rows])


def _to_pivots(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def dists(s: pd.Series) -> pd.Series:
        return pd.Series(list(_dist(_matrix(s), pivots)))

    return df.withColumn("_d", dists(c(vec).cast("array<double>")))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("_v")
    return v.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(v), -1)


class _Block:
    """Queries of a block with their k best points so far."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.v, self.k, self.exclude_self = ids, vectors, k, exclude_self
        self.plain = ids.to_numpy(zero_copy_only=False)
        self.square = (vectors * vectors).sum(1)
        self.bound = np.full(len(ids), np.inf)  # no point beyond it is among the k best
        self.dist = np.full((len(ids), k), np.inf)
        self.at = np.full((len(ids), k), -1, np.int32)  # places in known points
        self.near, self.target, self.known = ids.slice(0, 0), np.zeros(0), np.zeros(0, bool)
        self.new: list[tuple] = []
        self.n_new = 0

    def meet(self, ids: pa.Array, vectors: np.ndarray, y: pa.Array) -> None:
        if len(self.near) > max(SORTED, self.dist.size):
            self._forget()
        first = len(self.near)
        self.near = pa.concat_arrays([self.near, ids])
        self.target = np.append(self.target, y.fill_null(0.0).to_numpy(zero_copy_only=False))
        self.known = np.append(self.known, ~y.is_null().to_numpy(zero_copy_only=False))
        plain, square = ids.to_numpy(zero_copy_only=False), (vectors * vectors).sum(1)
        # as many of a row's nearest can be the row itself
        own = pc.max(pc.value_counts(ids).field("counts")).as_py() if self.exclude_self else 0
        with np.errstate(invalid="ignore", over="ignore", under="ignore"):
            kind, share = self._precision(square)
            # The squared distance is the sum of both squares less twice the product. What rounding takes or adds, in either
            # way of adding it up, is less than a share of both squares, which is taken off; so this is never too large.
            sides = np.vstack([-2.0 * vectors.T, square * (1 - share)]).astype(kind)
            mine = self.square * (1 - share)
            step = max(1, AT_ONCE // len(plain))
            for at in range(0, len(self.plain), step):
                part = slice(at, at + step)
                rough = np.column_stack([self.v[part], np.ones(len(self.v[part]))]).astype(kind) @ sides
                limit = self.bound[part] ** 2 * (1 + 1e-12) - mine[part]
                last = self.k - 1 + own
                if np.isinf(limit).any() and last < len(plain):
                    # without a bound yet: what the batch itself tells, as no point's square exceeds twice the query's and the distance's
                    within = np.partition(rough, last, axis=1)[:, last] + mine[part]
                    limit = np.minimum(limit, (within + 8 * share * self.square[part]) * (1 + 10 * share) - mine[part])
                limit = np.nextafter(limit.astype(kind), kind(np.inf))
                at_flat = np.flatnonzero(~(rough > limit[:, None]))
                self._measure(at_flat // len(plain) + at, at_flat % len(plain), plain, vectors, first)
        if self.n_new > self.dist.size // 4 or np.isinf(self.bound).any():
            self.settle()

    def _precision(self, square: np.ndarray) -> tuple:
        """The type to multiply in, and its rounding as a share of the squares: single where that is little of the k-th distances."""
        size = self.v.shape[1] + 8
        single, both = 5e-7 * size, np.median(self.square) + np.median(square)
        if single * both < 2e-3 * np.median(self.bound) ** 2 < np.inf and max(self.square.max(), square.max()) < 1e30:
            return np.float32, single
        return np.float64, 1e-15 * size

    def _measure(self, i, j, plain, vectors, first) -> None:
        """The distances of pairs of query and point, in the order of the coordinates."""
        for at in range(0, len(i), 1 << 9):
            a, b = i[at : at + (1 << 9)], j[at : at + (1 << 9)]
            if self.exclude_self:
                other = self.plain[a] != plain[b]
                a, b = a[other], b[other]
            d = self.v[a] - vectors[b]
            d *= d
            dist = np.sqrt(np.add.reduce(np.ascontiguousarray(d.T), axis=0))
            keep = np.isfinite(dist) & (dist <= self.bound[a])
            self.new.append((a[keep].astype(np.int32), dist[keep], (b[keep] + first).astype(np.int32)))
            self.n_new += len(self.new[-1][0])
        if self.n_new > max(SORTED, self.dist.size // 4):
            self.settle()

    def _forget(self) -> None:
        """Let go of the points that are among no query's best."""
        self.settle()
        used, place = np.unique(self.at, return_inverse=True)
        place, used = place.reshape(self.at.shape) - (used[0] < 0), used[used >= 0]
        self.at = place.astype(np.int32)
        self.near, self.target, self.known = self.near.take(pa.array(used)), self.target[used], self.known[used]

    def settle(self) -> None:
        """Keep the k best of each query; equal distances prefer the smaller id."""
        if not self.n_new:
            return
        of, dist, at = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.n_new = [], 0
        if (of[1:] < of[:-1]).any():
            order = np.argsort(of, kind="stable")
            of, dist, at = of[order], dist[order], at[order]
        ends = np.searchsorted(of, np.arange(len(self.plain) + 1))
        most, lo, past = np.diff(ends), int(of[0]), int(of[-1]) + 1
        while lo < past:
            hi = lo + 1
            widest = self.k + most[lo]
            while hi < past and (hi + 1 - lo) * max(widest, self.k + most[hi]) <= SORTED:
                widest, hi = max(widest, self.k + most[hi]), hi + 1
            some = slice(ends[lo], ends[hi])
            self._best(lo, hi, int(widest), of[some] - lo, np.arange(ends[lo], ends[hi]) - ends[of[some]], dist[some], at[some])
            lo = hi

    def _best(self, lo: int, hi: int, width: int, row, column, dist, at) -> None:
        k = self.k
        d, p = np.full((hi - lo, width), np.inf), np.full((hi - lo, width), -1, np.int32)
        d[:, :k], p[:, :k] = self.dist[lo:hi], self.at[lo:hi]
        d[row, column + k], p[row, column + k] = dist, at
        last = np.partition(d, k - 1, axis=1)[:, k - 1]
        keep, level = d < last[:, None], (d == last[:, None]) & np.isfinite(last)[:, None]
        left = k - keep.sum(1)
        crowded = level.sum(1) > left
        keep |= level & ~crowded[:, None]
        if crowded.any():
            i, j = np.nonzero(level & crowded[:, None])
            i, j, rank = self._by_id(i, j, p[i, j])
            first = rank < left[i]
            keep[i[first], j[first]] = True
        i, j = np.nonzero(keep)
        place = np.arange(len(i)) - np.searchsorted(i, i)
        self.dist[lo:hi], self.at[lo:hi] = np.inf, -1
        self.dist[lo + i, place], self.at[lo + i, place] = d[i, j], p[i, j]
        self.bound[lo:hi] = last

    def _by_id(self, i, j, at) -> tuple:
        """Places (i, j) of the points in the order of i and the id, with their rank in i."""
        used, inverse = np.unique(at, return_inverse=True)
        rank = np.empty(len(used), np.int64)
        rank[pc.sort_indices(self.near.take(pa.array(used)), null_placement="at_start").to_numpy()] = np.arange(len(used))
        order = np.lexsort((rank[inverse], i))
        i, j = i[order], j[order]
        return i, j, np.arange(len(i)) - np.searchsorted(i, i)

    def result(self, schema: pa.Schema, rows: int = 1024) -> Iterator[pa.RecordBatch]:
        self.settle()
        kind = schema.field("_b").type.value_type
        for lo in range(0, len(self.plain), rows):
            dist, at = self.dist[lo : lo + rows], self.at[lo : lo + rows]
            order = np.argsort(dist, axis=1, kind="stable")
            dist, at = np.take_along_axis(dist, order, 1), np.take_along_axis(at, order, 1)
            n = np.isfinite(dist).sum(1)
            level = ((dist[:, 1:] == dist[:, :-1]) & np.isfinite(dist[:, 1:])).any(1)
            if level.any():
                # equal distances: by id within the rows that have some
                i, j = np.nonzero(np.isfinite(dist) & level[:, None])
                i, j, rank = self._by_id(i, j, at[i, j])
                d, p = dist[i, j], at[i, j]
                order = np.lexsort((rank, d, i))
                place = np.arange(len(i)) - np.searchsorted(i, i)
                dist[i, place], at[i, place] = d[order], p[order]
            full = np.isfinite(dist)
            at, ends = at[full], np.append(0, np.cumsum(n))
            near = pa.StructArray.from_arrays(
                [pa.array(dist[full]), self.near.take(pa.array(at)), pa.array(self.target[at], mask=~self.known[at])], fields=list(kind)
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near, type=schema.field("_b").type)
            yield pa.RecordBatch.from_arrays([self.ids.slice(lo, rows), lists], schema=schema).filter(pa.array(n > 0))


def _nearest(k: int, exclude_self: bool):
    """Over blocks and packs of points, a block before its packs: each query of the block with its k nearest points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        waiting: dict[int, list] = {}
        schema = None

        def meet(name: int) -> None:
            ids, v, y = zip(*waiting.pop(name))
            blocks[name].meet(pa.concat_arrays(ids), np.concatenate(v), pa.concat_arrays(y))

        for batch in batches:
            if schema is None:
                id_type = batch.schema.field("_id").type.value_type
                near = pa.struct([("dist", pa.float64()), ("near_id", id_type), ("target", pa.float64())])
                schema = pa.schema([("_id", id_type), ("_b", pa.list_(near))])
            for row in range(len(batch)):
                name, at = batch.column("_block")[row].as_py(), {x: batch.column(x)[row] for x in ("_q", "_qv", "_id", "_v", "_y")}
                if at["_qv"].is_valid:
                    q = pa.concat_arrays([at["_q"].values, at["_q"].values.slice(0, 0)])
                    blocks[name] = _Block(q, _unpacked(at["_qv"], len(q)).copy(), k, exclude_self)
                    continue
                # copies, so that a batch can go
                ids, y = (pa.concat_arrays([at[x].values, at[x].values.slice(0, 0)]) for x in ("_id", "_y"))
                waiting.setdefault(name, []).append((ids, _unpacked(at["_v"], len(ids)).copy(), y))
                if sum(x[1].size for x in waiting[name]) >= MET:
                    meet(name)
        for name in list(blocks):
            if name in waiting:
                meet(name)
            yield from blocks.pop(name).result(schema)

    return run


def _unpacked(v: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(v.as_buffer()).reshape(n, -1)


def _query_pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a partition: its queries and the cells that any of them reaches."""
    whole = [b for b in batches if len(b)]
    if not whole:
        return
    table = pa.Table.from_batches(whole)
    for name in pc.unique(table.column("_block")):
        part = table.filter(pc.equal(table.column("_block"), name)).combine_chunks().to_batches()[0]
        cells = pc.unique(part.column("_cells").flatten())
        yield _row({"_block": pa.array([name.as_py()], pa.int32()), "_cells": cells, "_q": part.column("_id"), "_qv": pa.array([_vectors(part).tobytes()], pa.binary())})


def _row(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row; but for single values and packed vectors, an array becomes a list."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    single = ("_block", "_qv", "_v", "_cell", "n", "lo", "hi")
    return pa.RecordBatch.from_arrays([x if k in single else one(x) for k, x in columns.items()], names=list(columns))


def _point_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sorted by cell in packs of one cell, with their number and least and greatest distance from the pivot."""
    waiting: list[pa.RecordBatch] = []
    held = 0

    def pack() -> pa.RecordBatch:
        part = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        cell, r = (part.column(x).to_numpy(zero_copy_only=False) for x in ("_cell", "_r"))
        return _row(
            {
                "_cell": pa.array(cell[:1], pa.int32()), "n": pa.array([len(r)], pa.int64()), "lo": pa.array([np.fmin.reduce(r)]), "hi": pa.array([r.max()]),
                "_id": part.column("_id"), "_v": pa.array([_vectors(part).tobytes()], pa.binary()), "_y": part.column("_y"),
            }
        )

    for batch in batches:
        cell = batch.column("_cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        for lo, hi in zip(cuts, cuts[1:]):
            if waiting and waiting[-1].column("_cell")[-1].as_py() != cell[lo]:
                yield pack()
                waiting, held = [], 0
            while lo < hi:
                to = min(hi, lo + PACK - held)
                waiting.append(batch.slice(lo, to - lo))
                held, lo = held + to - lo, to
                if held >= PACK:
                    yield pack()
                    waiting, held = [], 0
    if waiting:
        yield pack()


def knn_mean(
    points: DataFrame,
    queries: DataFrame,
    id_col: str,
    vec: str,
    target: str,
    k: int = 350,
    pivots: int | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, knn_mean): mean target of the k nearest points; equal distances prefer the smaller id."""
    if pivots is None:
        pivots = min(4096, max(16, int(points.count() ** 0.5)))
    piv = choose_pivots(points, id_col, vec, pivots)
    near = F.array_position(F.col("_d"), F.array_min("_d")).cast("int") - 1
    id_type = dict(queries.dtypes)[id_col]
    as_vector = c(vec).cast("array<double>").alias("_v")
    pts = _to_pivots(points.select(id_col, vec, target), vec, piv).withColumns({"_cell": near, "_r": F.array_min("_d")})
    pts = pts.where(F.col("_cell").isNotNull()).sortWithinPartitions("_cell")
    pts = pts.select("_cell", "_r", c(id_col).cast(id_type).alias("_id"), as_vector, c(target).cast("double").alias("_y"))
    pts = cut(pts.mapInArrow(_point_packs, f"_cell int, n long, lo double, hi double, _id array<{id_type}>, _v binary, _y array<double>"))
    cells = pts.groupBy("_cell").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo")).collect()  # one row per pivot
    info = np.array([[r["_cell"], r["n"], r["hi"], r["lo"]] for r in cells], dtype="float64").reshape(-1, 4)
    ids, size, hi, lo = info[:, 0].astype(int), info[:, 1], info[:, 2], info[:, 3]
    need = k + (1 if exclude_self else 0)

    @F.pandas_udf("array<int>")
    def reachable(s: pd.Series) -> pd.Series:
        out = []
        for d in s:
            d = np.asarray(d)[ids]
            far = d + hi
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(size[order]), need)
            bound = far[order[min(enough, len(order) - 1)]]
            low = np.maximum(np.maximum(d - hi, lo - d), 0.0)
            out.append([int(x) for x in ids[low <= bound * (1 + 1e-9) + 1e-12]])
        return pd.Series(out)

    # a block is a slice of the queries of one cell, and reads the packs with points of the cells that any of them reaches
    q = _to_pivots(queries.select(id_col, vec), vec, piv)
    q = cut(q.withColumns({"_own": near, "_cells": reachable("_d")}).drop("_d"))
    rows = max(1, min(block_rows, HELD // k))
    ids_alone = q.groupBy(id_col).count().where("count > 1").isEmpty()
    slices = q.where(F.col("_own").isNotNull()).groupBy("_own").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")).collect()  # one row per pivot
    first = np.cumsum([0, *(r["_n"] for r in slices)]).tolist()
    starts = q.sparkSession.createDataFrame([(r["_own"], r["_n"], n) for r, n in zip(slices, first)], "_own int, _n int, _first int")
    own = F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.col("_n")).cast("int")
    q = q.join(F.broadcast(starts), "_own").select((F.col("_first") + own).alias("_block"), "_cells", c(id_col).alias("_id"), as_vector)
    # a block has a partition of its own, here and where it meets its points
    q = q.repartitionById(max(1, first[-1]), F.col("_block"))
    q = cut(q.mapInArrow(_query_pack, f"_block int, _cells array<int>, _q array<{id_type}>, _qv binary"))
    reach = q.select("_block", F.explode("_cells").alias("_cell"))
    as_query = q.select("_block", F.lit(0).alias("_kind"), "_q", "_qv")
    as_point = pts.join(F.broadcast(reach), "_cell").select("_block", F.lit(1).alias("_kind"), "_id", "_v", "_y")
    met = as_query.unionByName(as_point, allowMissingColumns=True)
    met = met.repartitionById(max(1, first[-1]), F.col("_block")).sortWithinPartitions("_block", "_kind")
    hits = met.select("_block", "_q", "_qv", "_id", "_v", "_y").mapInArrow(
        _nearest(k, exclude_self), f"_id {id_type}, _b array<struct<dist:double,near_id:{id_type},target:double>>"
    )
    if not ids_alone:
        # rows of one id can lie in several blocks
        best = F.slice(F.sort_array(F.flatten(F.collect_list("_b"))), 1, k)
        hits = hits.groupBy("_id").agg(best.alias("_b"))
    return hits.select(
        c("_id").alias(id_col),
        F.size("_b").alias("n_near"),
        (F.aggregate("_b", F.lit(0.0), lambda a, e: a + e["target"]) / F.size("_b")).alias("knn_mean"),
    )


def scale_vectors(df: DataFrame, vec: str, out: str, size: int) -> DataFrame:
    """Standard-scale every coordinate over all rows (population deviation)."""
    at = [F.get(c(vec), i).cast("double") for i in range(size)]
    s = df.agg(
        F.struct(
            F.array(*[F.avg(x) for x in at]).alias("m"), F.array(*[F.stddev_pop(x) for x in at]).alias("s")
        ).alias("s")
    ).scalar()
    x = df.withColumn("_s", s)
    z = F.transform(
        F.arrays_zip(c(vec).cast("array<double>").alias("v"), F.col("_s.m").alias("m"), F.col("_s.s").alias("s")),
        lambda e: F.coalesce(F.try_divide(e["v"] - e["m"], e["s"]), F.lit(0.0)),
    )
    return x.withColumn(out, z).drop("_s")

