"""AUC, error metrics, subgroup metrics, blending and residuals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import islice
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, has_all, ratio
from ..session import cut
from .attach import SIZE, attach, group_size
from .ordering import ranked, running_totals


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """ROC AUC with ties at half weight, overall or per segment; NULL for one class only.

    Rows are added up per distinct score before anything is ordered.
    """
    m = {
        "_pos": F.sum((c(label) == 1).cast("long")),
        "_neg": F.sum((c(label) == 0).cast("long")),
    }
    src = df.where(c(label).isNotNull()).select(*by, label, score)
    per = running_totals(src, score, m, by, **kw)
    pos, neg, before = F.col("_pos").cast("double"), F.col("_neg").cast("double"), F.col("_neg_before").cast("double")
    agg = [
        F.sum(pos * (before + neg / 2)).alias("_w"),
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
    ]
    out = per.groupBy(*by).agg(*agg)
    return out.withColumn("auc", F.try_divide("_w", F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_w")


def feature_auc(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """AUC of each column alone, in the better direction; all columns in one long pass."""
    long = df.where(c(label).isNotNull()).select(label, *[c(x).cast("double").alias(x) for x in cols])
    long = long.unpivot([label], list(cols), "feature", "value")
    a = auc(long, label, "value", ["feature"])
    return a.select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))


def regression_errors(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, R2 and MAPE, overall or per pattern."""
    return df.groupBy(*by).agg(*_errors(actual, pred))


def _errors(actual: str, pred: str) -> list[Column]:
    e = c(actual) - c(pred)
    sse, n = F.sum(e * e), F.count(e)
    return [
        F.sqrt(sse / n).alias("rmse"),
        (1 - F.try_divide(sse, F.var_pop(actual) * n)).alias("r2"),
        F.avg(F.abs(F.try_divide(e, c(actual)))).alias("mape"),
    ]


def errors_with_all(df: DataFrame, actual: str, pred: str, pattern: str) -> DataFrame:
    """Errors per pattern value and for all rows under ``all``, in one pass."""
    x = df.withColumn("_pattern", c(pattern).cast("string"))
    per = x.groupingSets([["_pattern"], []], "_pattern").agg(*_errors(actual, pred), F.grouping("_pattern").alias("_total"))
    return per.select(F.when(F.col("_total") == 1, "all").otherwise(F.col("_pattern")).alias(pattern), "rmse", "r2", "mape")


def subgroup_aucs(df: DataFrame, label: str, score: str, subgroups: Sequence[str]) -> DataFrame:
    """Per subgroup flag: subgroup, BPSN and BNSP AUC.

    The masks add the 0/1 flag and the 0/1 label: BPSN keeps sums of 1, BNSP
    everything else.
    """
    kinds = []
    for g in subgroups:
        s = c(g) + c(label)
        kinds += [
            F.when(c(g) == 1, F.struct(F.lit(g).alias("subgroup"), F.lit("subgroup_auc").alias("kind"))),
            F.when(s == 1, F.struct(F.lit(g).alias("subgroup"), F.lit("bpsn_auc").alias("kind"))),
            F.when(s != 1, F.struct(F.lit(g).alias("subgroup"), F.lit("bnsp_auc").alias("kind"))),
        ]
    long = df.select(label, score, F.explode(F.array_compact(F.array(*kinds))).alias("_k"))
    long = long.select(label, score, "_k.subgroup", "_k.kind")
    return auc(long, label, score, ["subgroup", "kind"]).groupBy("subgroup").pivot(
        "kind", ["subgroup_auc", "bpsn_auc", "bnsp_auc"]
    ).agg(F.first("auc"))


def subgroup_metric(
    df: DataFrame, label: str, score: str, subgroups: Sequence[str], power: float = -5, overall_weight: float = 0.25
) -> DataFrame:
    """One row: overall AUC, power means of the three subgroup AUCs, weighted total.

    A subgroup with one class only has no AUC; its mean and the total are NULL then.
    """
    kinds = ["subgroup_auc", "bpsn_auc", "bnsp_auc"]
    per = subgroup_aucs(df, label, score, subgroups)
    n = F.count(F.lit(1))
    means = per.agg(
        *[F.when(F.count(k) == n, F.pow(F.avg(F.pow(k, F.lit(power))), F.lit(1.0 / power))).alias(k) for k in kinds]
    )
    out = means.withColumn("overall_auc", auc(df, label, score).select("auc").scalar())
    bias = reduce(add, [F.col(k) for k in kinds]) / len(kinds)
    return out.withColumn("final_metric", overall_weight * F.col("overall_auc") + (1 - overall_weight) * bias)


def class_weight(subgroups: Sequence[str], label: str, threshold: float = 0.5, factor: float = 2.0) -> Column:
    """1, plus ``factor`` for negatives that belong to a subgroup."""
    inside = reduce(lambda a, b: a | b, [F.coalesce(c(g), F.lit(0)) >= threshold for g in subgroups])
    return F.lit(1.0) + F.when(inside & (F.coalesce(c(label), F.lit(0)) < threshold), factor).otherwise(0.0)


# -- predictions ------------------------------------------------------------------


def collect_predictions(oof: Sequence[DataFrame], test: Sequence[DataFrame], key: str, pred: str) -> DataFrame:
    """Out-of-fold rows as they are plus the mean of the folds for test rows."""
    folds = reduce(DataFrame.unionByName, test).groupBy(key).agg(F.avg(pred).alias(pred))
    return reduce(DataFrame.unionByName, [d.select(key, pred) for d in oof]).unionByName(folds)


def blend(preds: Mapping[str, DataFrame], weights: Mapping[str, float], key: str, pred: str) -> DataFrame:
    j = join_models(preds, key, pred)
    total = reduce(add, [F.col(n) * F.lit(float(w)) for n, w in weights.items()])
    return j.select(key, total.alias(pred))


def join_models(preds: Mapping[str, DataFrame], key: str, pred: str) -> DataFrame:
    """One column per model, joined by key."""
    parts = [d.select(key, c(pred).alias(n)) for n, d in preds.items()]
    return reduce(lambda a, b: a.join(b, key), parts)


def weight_grid(n: int, step: float) -> list[tuple[float, ...]]:
    return list(weight_vectors(n, step))


def weight_vectors(n: int, step: float) -> Iterator[tuple[float, ...]]:
    """Weights that sum to one on a grid, one by one; equal weights are part of it. Only valid weights are ever made."""
    k = round(1 / step)

    def parts(left: int, n: int):
        if n == 1:
            yield (left,)
        else:
            for i in range(1, left - n + 2):
                for rest in parts(left - i, n - 1):
                    yield (i, *rest)

    if k >= n:
        yield from (tuple(i / k for i in w) for w in parts(k, n))


def best_blend(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """The row of ``blend_search`` with the highest AUC; ties go to the smallest weights in the order of the models."""
    return scores.orderBy(F.desc("auc"), *[f"w_{m}" for m in models]).limit(1)


def _score_cells(df: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """Rows with equal scores and label, added up."""
    return df.where(c(label).isNotNull()).groupBy(label, *models).agg(F.count(F.lit(1)).alias("_n"))


def blend_search(df: DataFrame, label: str, models: Sequence[str], step: float = 0.1) -> DataFrame:
    """AUC for each weight vector of a coarse grid. ``find_best_blend`` is for fine ones."""
    return _window_aucs(_score_cells(df, label, models), label, models, weight_grid(len(models), step))


# Weight vectors that share a pass, and cells of score and weight that a task counts.
VECTORS, COUNTED = 4096, 1 << 23
FEW_VECTORS = 32
# Rows of score and vector that the exact AUCs rank at a time; while more are left, finer buckets go on ruling vectors out.
RANKED, MOST_BUCKETS = 1 << 26, 1 << 19
# Rows of a pack, those worked on at a time, and rows of a slice that the exact AUCs sort.
PACK, AT_ONCE, SLICE = 1 << 17, 1 << 14, 1 << 20


def find_best_blend(df: DataFrame, label: str, models: Sequence[str], step: float = 0.01, buckets: int = 512) -> DataFrame:
    """The row that ``best_blend`` picks from the AUCs of the whole grid, without the exact AUC of every vector.

    Counts of both classes in buckets of the blended score bound a vector's AUC: pairs
    in different buckets are decided, those in one bucket are not. Only vectors whose
    upper bound reaches the best lower bound go on, to finer buckets, and the last few
    to the exact AUC, the highest upper bounds first. Chance alone moves an AUC by
    the inverse root of the rows, so the first buckets are a few times as many as
    that root. Every pass takes a bounded number of vectors.
    """
    models = list(models)
    packs = _packed(_score_cells(df, label, models), label, models)
    ends = packs.agg(F.min("low"), F.max("high"), F.sum(F.col("neg") + F.col("pos"))).first()
    low, high, n_cells = (float(x or 0.0) for x in ends)
    left = weight_vectors(len(models), step)
    buckets = max(buckets, 1 << max(0, int(8 * n_cells**0.5)).bit_length())
    buckets = min(buckets, MOST_BUCKETS)
    while True:
        held: list[tuple[float, tuple[float, ...]]] = []
        best = -1.0
        while chunk := list(islice(left, max(1, min(VECTORS, COUNTED // buckets)))):
            bounds = _pack_bounds(packs, chunk, low, high, n_cells, buckets)
            best = max([best, *(b[0] for b in bounds)])
            held = [x for x in held + [(b[1], w) for b, w in zip(bounds, chunk)] if x[0] >= best - 1e-9]
        few = len(held) <= FEW_VECTORS and len(held) * n_cells <= RANKED
        if few or len(held) <= 1 or buckets >= MOST_BUCKETS:
            break
        left, buckets = iter([w for _, w in held]), min(buckets * 8, MOST_BUCKETS)
    held.sort(key=lambda x: (-x[0], x[1]))
    rows, at_once = [], int(max(1, min(FEW_VECTORS, RANKED // max(1, n_cells))))
    while held:
        rows += best_blend(_exact_aucs(packs, label, models, [w for _, w in held[:at_once]]), models).collect()
        best = max([best, *(r["auc"] for r in rows if r["auc"] is not None)])
        held = [x for x in held[at_once:] if x[0] >= best - 1e-9]
    schema = _exact_aucs(packs.limit(0), label, models, [tuple(1.0 for _ in models)]).schema
    return best_blend(df.sparkSession.createDataFrame(rows, schema), models)


def _packed(cells: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """Cells as arrays, negatives first, with the least and greatest finite score; a task of the passes to come reads whole packs."""
    size = max(1, PACK * 3 // max(3, len(models)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for b in batches:
            waiting.append([x.to_numpy(zero_copy_only=False) for x in b.columns])
            held += len(b)
            while held >= size:
                y, n, *x = (np.concatenate(v) for v in zip(*waiting))
                yield one(y[:size], n[:size], np.array([v[:size] for v in x]))
                waiting, held = [[v[size:] for v in (y, n, *x)]], held - size
        if held:
            y, n, *x = (np.concatenate(v) for v in zip(*waiting))
            yield one(y, n, np.array(x))

    def one(y: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(y, kind="stable")
        x, n, finite = x[:, order], n[order], x[np.isfinite(x)]
        ends = [float(finite.min()), float(finite.max())] if len(finite) else [None, None]
        counts = b"" if (n == 1).all() else n.astype("float64").tobytes()
        row = [int((y == 0).sum()), int((y == 1).sum()), *ends, x.astype("float64").tobytes(), counts]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["neg", "pos", "low", "high", "scores", "counts"])

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    rows = cells.where(c(label).isin(0, 1) & has_all(list(models)))
    rows = rows.select(c(label).cast("int"), "_n", *[F.col(m).cast("double").alias(m) for m in models])
    rows = rows.repartition(max(1, cells.sparkSession.sparkContext.defaultParallelism))
    return cut(rows.mapInArrow(pack, "neg long, pos long, low double, high double, scores binary, counts binary"))


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """The number of negatives, the scores model by model and the counts, if any is not 1, of every pack."""
    for b in batches:
        for neg, pos, x, n in zip(*(b.column(v) for v in ("neg", "pos", "scores", "counts"))):
            n = np.frombuffer(n.as_buffer()) if len(n.as_buffer()) else None
            yield neg.as_py(), np.frombuffer(x.as_buffer()).reshape(-1, neg.as_py() + pos.as_py()), n


def _histograms(packs: DataFrame, weights: list[tuple[float, ...]], low: float, high: float, n_cells: float, buckets: int) -> DataFrame:
    """Counts by class and bucket of the blended score of every weight vector, a row for each task and vector."""
    # buckets end between two whole numbers of the ninth digit, so that scores that round to one number share a bucket
    first = float(np.floor(low * 1e9)) - 2
    width = max(1.0, float(np.ceil((high * 1e9 + 2 - first) / buckets)))
    scaled, shift = np.array(weights) * (1e9 / width), (0.5 - first) / width

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(scaled), 2 * buckets))
        s, t = np.empty(AT_ONCE), np.empty(AT_ONCE)
        for neg, x, n in _unpacked(batches):
            at, tame = np.empty(x.shape[1], np.int64), bool(np.isfinite(x).all())
            cuts = sorted({*range(0, len(at), AT_ONCE), neg, len(at)})
            parts = [(lo, hi, shift, 0) if lo < neg else (lo, hi, shift + buckets, buckets) for lo, hi in zip(cuts, cuts[1:])]
            for k, v in enumerate(scaled):
                # a stretch at a time, so that what is worked on stays in the cache
                for lo, hi, add_to, side in parts:
                    a, b = s[: hi - lo], t[: hi - lo]
                    np.multiply(x[0, lo:hi], v[0], out=a)
                    for m in range(1, len(v)):
                        np.multiply(x[m, lo:hi], v[m], out=b)
                        a += b
                    a += add_to
                    if not tame:  # what is not a number comes last
                        np.fmin(np.fmax(a, side, out=a), side + buckets - 1, out=a, where=~np.isnan(a))
                        a[np.isnan(a)] = side + buckets - 1
                    np.copyto(at[lo:hi], a, casting="unsafe")
                total[k] += np.bincount(at, n, 2 * buckets)
        for k, v in enumerate(total):
            v = v.astype(np.min_scalar_type(int(v.max())))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.itemsize], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "size", "counts"])

    # a task has enough rows that its counts are worth their exchange
    tasks = max(1, min(packs.sparkSession.sparkContext.defaultParallelism, int(n_cells // PACK)))
    return packs.coalesce(tasks).mapInArrow(count, "k int, size int, counts binary")


def _summed(rows: pd.DataFrame, buckets: int) -> np.ndarray:
    return sum(np.frombuffer(x, f"u{n}").reshape(2, buckets).astype("float64") for x, n in zip(rows["counts"], rows["size"]))


def _pack_bounds(packs: DataFrame, weights: list[tuple[float, ...]], low: float, high: float, n_cells: float, buckets: int) -> list[tuple[float, float]]:
    """(lower, upper) AUC of every weight vector."""

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        neg, pos = _summed(rows, buckets)
        pairs = pos.sum() * neg.sum()
        lower = pos @ (np.cumsum(neg) - neg)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "lower": [lower / pairs if pairs else np.nan], "upper": [(lower + pos @ neg) / pairs if pairs else np.nan]})

    counts = _histograms(packs, weights, low, high, n_cells, buckets)
    found = {r["k"]: (r["lower"], r["upper"]) for r in counts.groupBy("k").applyInPandas(bound, "k int, lower double, upper double").collect()}
    return [found.get(k, (np.nan, np.nan)) for k in range(len(weights))]


def _auc_bounds(cells: DataFrame, label: str, models: Sequence[str], weights: list[tuple[float, ...]], low: float, high: float, buckets: int) -> list[tuple[float, float]]:
    """(lower, upper) AUC of every weight vector from counts by class and bucket of the blended score."""
    return _pack_bounds(_packed(cells, label, models), weights, low, high, PACK, buckets)


def _ninth_digit(s: np.ndarray) -> np.ndarray:
    """Scores rounded to nine digits as Spark rounds them: by their shortest decimal form, halves away from zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(s) * 1e9
        whole = np.floor(size + 0.5)
        out = np.copysign(whole / 1e9, s)
        out[out == 0] = 0.0
        large = ~(np.abs(s) < 1 << 23)  # neighbours there are more than a ninth digit apart
        out[large] = s[large]
        close = ~large & (np.abs(size - np.floor(size) - 0.5) <= 8 * np.spacing(size))
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _exact_aucs(packs: DataFrame, label: str, models: Sequence[str], grid: Sequence[tuple[float, ...]]) -> DataFrame:
    """AUC for each weight vector of a short list: scores are dealt by slices of their range and sorted there."""
    ends = packs.agg(F.min("low"), F.max("high"), F.sum(F.col("neg") + F.col("pos"))).first()
    low, high, n_cells = (float(x or 0.0) for x in ends)
    n_slices, buckets = int(n_cells // SLICE) + 1, 1 << 14
    edges = [np.zeros(0) for _ in grid]

    def edge(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.cumsum(_summed(rows, buckets).sum(0))
        at = np.searchsorted(n, n[-1] * np.arange(1, n_slices) / n_slices)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "at": [np.unique(at)]})

    if n_slices > 1:
        counts = _histograms(packs, list(grid), low, high, n_cells, buckets)
        for r in counts.groupBy("k").applyInPandas(edge, "k int, at array<long>").collect():
            edges[r["k"]] = low + (np.array(r["at"]) + 1.0) * ((high - low) / buckets)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for neg, x, n in _unpacked(batches):
            side = np.ones(x.shape[1]) if n is None else n.copy()
            side[:neg] *= -1  # negatives count below zero
            for k, v in enumerate(grid):
                s = x[0] * v[0]
                for m in range(1, len(v)):
                    s += x[m] * v[m]
                s = _ninth_digit(s)
                order = np.argsort(s)
                s, of = s[order], side[order]
                cuts = [0, *np.searchsorted(s, edges[k]), len(s)]
                parts = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(parts), pa.int32()),
                        pa.array([i for i, _, _ in parts], pa.int32()),
                        pa.array([s[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()),
                        pa.array([of[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()),
                    ],
                    names=["k", "slice", "scores", "sides"],
                )

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        s, of = (np.concatenate([np.frombuffer(x) for x in rows[v]]) for v in ("scores", "sides"))
        order = np.argsort(s)
        s, of = s[order], of[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~np.isnan(s[:-1])])
        pos, neg = np.add.reduceat(np.maximum(of, 0), first), np.add.reduceat(np.maximum(-of, 0), first)
        won = pos @ (np.cumsum(neg) - neg / 2)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "slice": rows["slice"].iloc[:1], "won": [won], "pos": [pos.sum()], "neg": [neg.sum()]})

    dealt = packs.mapInArrow(deal, "k int, slice int, scores binary, sides binary")
    per = dealt.groupBy("k", "slice").applyInPandas(rank, "k int, slice int, won double, pos double, neg double")
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))  # one row per vector and slice
    total = per.groupBy("k").agg(F.sum(F.col("won") + F.col("pos") * F.col("before")).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lits = F.array(*[F.array(*[F.lit(float(w)) for w in ws]) for ws in grid])
    return total.select(
        *[F.get(F.get(lits, "k"), i).alias(f"w_{m}") for i, m in enumerate(models)],
        F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"),
    )


def _window_aucs(cells: DataFrame, label: str, models: Sequence[str], grid: Sequence[tuple[float, ...]]) -> DataFrame:
    """AUC for each weight vector of a coarse grid."""
    lits = F.array(
        *[F.struct(*[F.lit(w).alias(f"w_{m}") for m, w in zip(models, ws)]) for ws in grid]
    )
    x = cells.withColumn("_w", F.explode(lits))
    score = reduce(add, [F.col(m) * F.col(f"_w.w_{m}") for m in models])
    x = x.select(label, "_n", *[F.col(f"_w.w_{m}") for m in models], F.round(score, 9).alias("_score"))
    by = [f"w_{m}" for m in models]
    m = {
        "_pos": F.sum(F.when(c(label) == 1, F.col("_n")).otherwise(0)),
        "_neg": F.sum(F.when(c(label) == 0, F.col("_n")).otherwise(0)),
    }
    per = running_totals(x, "_score", m, by)
    pos, neg, before = F.col("_pos").cast("double"), F.col("_neg").cast("double"), F.col("_neg_before").cast("double")
    return (
        per.groupBy(*by)
        .agg(F.sum(pos * (before + neg / 2)).alias("_s"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
        .select(*by, F.try_divide("_s", F.col("_p").cast("double") * F.col("_q")).alias("auc"))
    )


def rank_blend(df: DataFrame, weights: Mapping[str, str | Column], out: str) -> DataFrame:
    """Weighted sum of minimum-tie ranks; weights may differ by row."""
    x = df
    for i, m in enumerate(weights):
        x = ranked(x, m, {f"_rank{i}": "min"})
    total = reduce(add, [F.col(f"_rank{i}") * c(w) for i, w in enumerate(weights.values())])
    return x.withColumn(out, total).drop(*[f"_rank{i}" for i in range(len(weights))])


def override(pred: DataFrame, known: DataFrame, key: str, col: str, known_label: str, only_positive: bool = True) -> DataFrame:
    """Known labels replace predictions (only positives by default)."""
    j = pred.join(known.select(key, c(known_label).alias("_k")), key, "left")
    hit = F.col("_k") == 1 if only_positive else F.col("_k").isNotNull()
    return j.withColumn(col, F.when(hit, F.col("_k").cast("double")).otherwise(c(col))).drop("_k")


def rank_residual(a: DataFrame, b: DataFrame, key: str, pred: str, out: str = "residual") -> DataFrame:
    """Difference of two models' average ranks."""
    ra = ranked(a, pred, {"_ra": "average"}).select(key, "_ra")
    rb = ranked(b, pred, {"_rb": "average"}).select(key, "_rb")
    return ra.join(rb, key).select(key, F.col("_ra").alias("rank_a"), F.col("_rb").alias("rank_b"), (F.col("_ra") - F.col("_rb")).alias(out))


def residual_columns(df: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    return df.withColumns({f"res_{m}": c(label) - c(m) for m in models})


def largest_disagreements(df: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    return df.withColumn("gap", F.abs(c(a) - c(b))).orderBy(F.desc("gap"), key).limit(n)


def daily_prediction_gap(df: DataFrame, date: str, label: str, pred: str) -> DataFrame:
    """(date, series, value): label mean and prediction mean per day."""
    wide = df.where(c(label).isNotNull()).groupBy(date).agg(F.avg(label).alias("label_mean"), F.avg(pred).alias("pred_mean"))
    return wide.unpivot([date], ["label_mean", "pred_mean"], "series", "value")


def small_entity_auc(df: DataFrame, entity: str, label: str, score: str, at_most: int = 2) -> DataFrame:
    per = df.groupBy(entity).agg(group_size())
    per = per.select(entity, SIZE, (F.col(SIZE) <= at_most).alias("_small"))
    return auc(attach(df, per, [entity]).where("_small"), label, score)


def relative(a: str, b: str) -> Column:
    return ratio(a, b)
