"""Totals over all points below and above a point in two coordinates, without pairs.

Inside a group every point gets the total weight and the smallest id of the points
that are smaller in both coordinates, and of those that are larger in both. The
points of many groups are sorted by the first coordinate at once; then halves of
ever larger blocks meet in the order of the second coordinate, where running totals
answer all of them: n log n steps for n points, all of them array operations.

A group above ``rows_per_split`` points is cut into strips along both coordinates.
Points of one strip of the first coordinate are compared there; points of different
ones meet in their strip of the second coordinate, compared by strip number; and
what lies in different strips of both is added up per pair of strips, which are
points of a smaller problem of the same kind.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut
from .windows import sliced

ROWS_PER_SPLIT = 200_000
FOUND = ["below_n", "below_id", "above_n", "above_id"]


def sweep(g: np.ndarray, x: np.ndarray, y: np.ndarray, tie: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """``low`` is the weight of a point towards points above it, ``high`` towards points below it; weight 0 does not count.

    Both comparisons are strict; ``tie`` decides between equal ``y``. An id says nothing where its weight is 0.
    """
    n = len(x)
    by_y = np.lexsort((tie, y))
    fresh = np.r_[True, (np.diff(y[by_y]) != 0) | (np.diff(tie[by_y]) != 0)]
    rank = np.empty(n, np.int64)
    rank[by_y] = np.cumsum(fresh) - 1
    # Of equal x the larger y stands first, so that neither counts the other.
    order = np.lexsort((-rank, x, g))
    g, rank, low, high = g[order], rank[order], low[order], high[order]
    known, place = np.unique(ids[order], return_inverse=True)
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(n), 0))
    at = np.arange(n) - start
    width = 2 * (int(rank.max()) + 1)
    out = {"below_n": np.zeros(n, np.int64), "above_n": np.zeros(n, np.int64), "below_id": np.full(n, n), "above_id": np.full(n, n)}
    for level in range(int(at.max()).bit_length()):
        right = (at >> level) & 1
        block = start + ((at >> (level + 1)) << (level + 1))
        for side, points, weight, up in (("below", right == 0, low, rank), ("above", right == 1, high, width // 2 - 1 - rank)):
            # Points of the other half come after askers of an equal rank.
            way = np.argsort(block * width + 2 * up + points, kind="stable")
            first = block[way]
            w = np.where(points, weight, 0)[way]
            total = np.cumsum(w)
            total -= np.where(first > 0, total[first - 1], 0)
            # Later blocks are lower throughout, so that the running minimum starts anew with each.
            step = np.cumsum(np.r_[0, first[1:] != first[:-1]]) * (n + 1)
            least = np.minimum.accumulate(np.where(w > 0, place[way], n) - step) + step
            asks = ~points[way]
            to = way[asks]
            out[f"{side}_n"][to] += total[asks]
            out[f"{side}_id"][to] = np.minimum(out[f"{side}_id"][to], least[asks])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    known = np.append(known, np.zeros(n + 1 - len(known), np.int64))
    for side in ("below", "above"):
        out[f"{side}_id"] = known[out[f"{side}_id"]]
    return {k: v[back] for k, v in out.items()}


def _swept(points: DataFrame, group: Sequence[str], x: str, y: str, tie: str, rows_per_split: int) -> DataFrame:
    """(point, FOUND) by buckets of whole groups."""
    n_buckets = max(1, -(-points.count() // rows_per_split))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.groupby(list(group), sort=False, dropna=False).ngroup().to_numpy()
        cols = [rows[k].to_numpy(dtype="int64") for k in (x, y, tie, "low", "high", "id")]
        return pd.DataFrame({"point": rows["point"], **sweep(g, *cols)})

    bucket = F.pmod(F.xxhash64(*group), F.lit(n_buckets)).alias("_bucket")
    rows = points.select("point", *group, *dict.fromkeys([x, y, tie]), "low", "high", "id")
    return rows.groupBy(bucket).applyInPandas(run, "point long, " + ", ".join(f"{k} long" for k in FOUND))


def dominance_totals(points: DataFrame, group: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(point, below_n, below_id, above_n, above_id) for ``points``: ``point`` (unique), the group's columns, ``x``, ``y``, ``low``, ``high`` (weights), ``id``.

    All but the group are whole numbers. Both comparisons are strict. One or more rows per point, to be added
    up; an id says nothing where its total is 0.
    """
    group = list(group)
    # Ties are broken against each other, so that points equal in one coordinate are never below each other.
    points = points.withColumns({"_tie": -c("x"), "_tie_x": -c("y")})
    in_x, hot = sliced(points, group, ["x", "_tie_x"], rows_per_split)
    if not hot:
        return _swept(points, group, "x", "y", "_tie", rows_per_split)
    in_x = cut(in_x.withColumnRenamed("_slice", "_xs"))
    found = _swept(in_x, [*group, "_xs"], "x", "y", "_tie", rows_per_split)
    both = in_x.where("_xs > 0")
    both, _ = sliced(both, group, ["y", "_tie"], rows_per_split)
    both = cut(both.withColumnRenamed("_slice", "_ys"))
    found = found.unionByName(_swept(both, [*group, "_ys"], "_xs", "y", "_tie", rows_per_split))
    # Pairs of strips: one point for each that holds any.
    tiles = both.groupBy(*group, F.col("_xs").alias("x"), F.col("_ys").alias("y")).agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.min(F.when(c("low") > 0, c("id"))).alias("low_id"), F.min(F.when(c("high") > 0, c("id"))).alias("high_id")
    )
    tiles = cut(tiles.withColumn("tile", F.monotonically_increasing_id()))
    none = F.lit(0).cast("long")
    parts = []
    for side, weight, other in (("below", "low", "high"), ("above", "high", "low")):
        one = tiles.select("tile", *group, "x", "y", weight, none.alias(other), F.coalesce(f"{weight}_id", none).alias("id")).withColumnRenamed("tile", "point")
        answer = dominance_totals(one, group, rows_per_split).groupBy("point").agg(F.sum(f"{side}_n").alias("n"), F.min(F.when(c(f"{side}_n") > 0, c(f"{side}_id"))).alias("i"))
        parts.append(answer.select(F.col("point").alias("tile"), F.col("n").alias(f"{side}_n"), F.coalesce("i", none).alias(f"{side}_id")))
    answer = parts[0].join(parts[1], "tile").join(tiles.select("tile", *group, "x", "y"), "tile")
    answer = answer.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(group)], F.col("x").alias("_tx"), F.col("y").alias("_ty"), *FOUND)
    same = (F.col("_xs") == F.col("_tx")) & (F.col("_ys") == F.col("_ty"))
    for i, k in enumerate(group):
        same = same & c(k).eqNullSafe(F.col(f"_g{i}"))
    return found.unionByName(both.join(answer, same).select("point", *FOUND))
