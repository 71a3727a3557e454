"""Data quality, drift between splits and correlations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, no_nan, ratio
from .ordering import running_totals


def audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, nulls, infs) of numeric columns from one aggregate."""
    inf = float("inf")
    aggs = []
    for x in cols:
        v = c(x).cast("double")
        aggs.append(
            F.struct(
                F.lit(x).alias("feature"),
                F.count_if(v.isNull() | F.isnan(v)).alias("nulls"),
                F.count_if((v == inf) | (v == -inf)).alias("infs"),
                F.max(F.when(~F.isnan(v), v)).alias("max_value"),
                F.min(F.when(~F.isnan(v), v)).alias("min_value"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, is_constant): smallest value equals largest value, nulls aside."""
    items = [
        F.struct(F.lit(x).alias("feature"), F.coalesce((F.min(x) == F.max(x)).cast("int"), F.lit(0)).alias("is_constant"))
        for x in cols
    ]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def drop_constant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bad = [r["feature"] for r in constant_columns(df, cols).where("is_constant = 1").collect()]
    return df.drop(*bad)


def variances(df: DataFrame, cols: Sequence[str], sample: float | None = None, seed: int = 71) -> DataFrame:
    src = df.sample(sample, seed) if sample else df
    wide = src.agg(*[no_nan(F.variance(c(x).cast("double"))).alias(x) for x in cols])
    return wide.unpivot([], list(cols), "feature", "variance")


def low_variance(df: DataFrame, cols: Sequence[str], limit: float = 0.0, **kw) -> list[str]:
    return sorted(r["feature"] for r in variances(df, cols, **kw).where(F.col("variance") <= limit).collect())


# Columns of a tile of the product matrices.
TILE = 64


def correlation_pairs(df: DataFrame, cols: Sequence[str], tile: int = TILE) -> DataFrame:
    """(col_a, col_b, corr) of the upper triangle over pairwise complete rows; NULL where a column does not vary.

    A task turns its rows into a matrix of values and a mask of what is present; the
    products of the two give, for all pairs of columns at once, the number of common
    rows and their sums, squares and products. A task holds 32 bytes per pair of
    columns and sends its sums in tiles, one shuffled row for each pair of tiles.
    """
    cols = list(cols)
    frame = df.select(*[no_nan(c(x).cast("double")).alias(f"_{i}") for i, x in enumerate(cols)])
    # Values count from their mean, so that sums of squares keep their digits.
    means = frame.agg(*[F.avg(f"_{i}") for i in range(len(cols))]).first()
    origin = np.array([m or 0.0 for m in means])
    edges = [(k, min(k + tile, len(cols))) for k in range(0, len(cols), tile)]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(cols), len(cols)))
        for batch in batches:
            v = np.column_stack([x.to_numpy(zero_copy_only=False).astype("float64") for x in batch.columns]) - origin
            there = (~np.isnan(v)).astype("float64")
            v = np.where(there > 0, v, 0.0)
            for k, (left, right) in enumerate(((there, there), (v, there), (v * v, there), (v, v))):
                total[k] += left.T @ right
        tiles = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))] if total[0].any() else []
        for i, j in tiles:
            at, to = slice(*edges[i]), slice(*edges[j])
            both = np.stack([total[0, at, to], total[1, at, to], total[1, to, at].T, total[2, at, to], total[2, to, at].T, total[3, at, to]])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=["i", "j", "sums"])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        n, x, y, xx, yy, xy = sum(np.frombuffer(s).reshape(6, edges[i][1] - edges[i][0], -1) for s in rows["sums"])
        spread_x, spread_y = n * xx - x * x, n * yy - y * y
        # What is left by rounding is no spread.
        varies = (spread_x > 1e-12 * n * xx) & (spread_y > 1e-12 * n * yy)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(varies, (n * xy - x * y) / np.sqrt(spread_x * spread_y), np.nan)
        a, b = np.meshgrid(np.arange(*edges[i]), np.arange(*edges[j]), indexing="ij")
        keep = a < b
        names = np.array(cols, dtype=object)
        return pd.DataFrame({"col_a": names[a[keep]], "col_b": names[b[keep]], "corr": np.clip(r[keep], -1, 1)})

    # One task per core: what a task sends does not depend on its rows.
    parts = frame.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).mapInArrow(sums, "i int, j int, sums binary")
    pairs = parts.groupBy("i", "j").applyInPandas(finish, "col_a string, col_b string, corr double")
    return pairs.withColumn("corr", no_nan("corr"))


def correlated_to_drop(df: DataFrame, cols: Sequence[str], threshold: float = 0.999, absolute: bool = False) -> list[str]:
    """Columns correlated with an earlier one; the later of each pair goes."""
    r = F.abs("corr") if absolute else F.col("corr")
    hits = correlation_pairs(df, cols).where(r >= threshold).select("col_b").distinct().collect()
    return [x for x in cols if x in {h[0] for h in hits}]


def covered_columns(df: DataFrame, cols: Sequence[str], limit: float) -> list[str]:
    """Columns that a kept earlier column covers: from left to right, a column that still stands
    drops its correlated partners, and a dropped column drops nobody."""
    hits = {(r["col_a"], r["col_b"]) for r in correlation_pairs(df, cols).where(F.abs("corr") >= limit).collect()}
    gone: set[str] = set()
    for i, a in enumerate(cols):
        if a not in gone:
            gone |= {b for b in cols[i + 1 :] if (a, b) in hits}
    return [x for x in cols if x in gone]


def remove_columns(df: DataFrame, cols: Sequence[str], var_limit=0.0, corr_limit=1.0, only_var=True) -> DataFrame:
    """Low variance first, then the columns a kept one is highly correlated with."""
    low = low_variance(df, cols, var_limit)
    out, left = df.drop(*low), [x for x in cols if x not in low]
    return out if only_var else out.drop(*covered_columns(out, left, corr_limit))


def ranked_partners(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every column's partners by falling absolute correlation; one row per ordered pair."""
    up = correlation_pairs(df, cols)
    both = up.unionByName(up.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"))
    # the table holds columns, not rows of data
    w = Window.partitionBy("col_a").orderBy(F.desc(F.abs(F.round("corr", 9))), "col_b")
    return both.withColumn("rank", F.row_number().over(w))


def label_correlation(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    items = [
        F.struct(
            F.lit(x).alias("feature"),
            no_nan(F.corr(c(label).cast("double"), F.coalesce(c(x).cast("double"), F.lit(0.0)))).alias("corr"),
        )
        for x in cols
    ]
    return df.where(c(label).isNotNull()).agg(F.array(*items).alias("a")).select(F.inline("a"))


def best_candidate(corrs: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Per base name the candidate column containing it with the largest |corr|."""
    base = F.explode(F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: F.col("feature").contains(b)))
    x = corrs.withColumn("base", base)
    best = F.min(F.struct((-F.abs("corr")).alias("r"), F.col("feature").alias("f")))
    return x.groupBy("base").agg(best.alias("b")).select("base", F.col("b.f").alias("feature"), (-F.col("b.r")).alias("corr"))


def long_form(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[c(x).cast("double").alias(x) for x in cols]).unpivot(list(ids), list(cols), "feature", "value")


def ks_two_sample(df: DataFrame, split: str, cols: Sequence[str], level: float = 0.1, terms: int = 100, **kw) -> DataFrame:
    """Two-sample KS per column: distance, asymptotic p-value, keep flag.

    All columns go through one running-total pass in long form.
    """
    long = long_form(df, [split], cols).where(F.col("value").isNotNull())
    one = {"_a": F.sum((c(split) == "train").cast("long")), "_b": F.sum((c(split) != "train").cast("long"))}
    pos = running_totals(long, "value", one, ["feature"], **kw)
    # totals of the listed columns as one small map, looked up without a join
    tr = c(split) == "train"
    sizes = [
        F.struct(F.count_if(tr & c(x).isNotNull()).alias("n_train"), F.count_if(~tr & c(x).isNotNull()).alias("n_test"))
        for x in cols
    ]
    pairs = [y for x, n in zip(cols, sizes) for y in (F.lit(x), n)]
    pos = pos.withColumn("_t", F.element_at(df.agg(F.create_map(*pairs)).scalar(), F.col("feature"))).select("*", "_t.*")
    gap = F.abs(
        F.try_divide(F.col("_a_before") + F.col("_a"), F.col("n_train"))
        - F.try_divide(F.col("_b_before") + F.col("_b"), F.col("n_test"))
    )
    d = pos.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.first("n_train").alias("n_train"), F.first("n_test").alias("n_test")
    )
    en = F.sqrt(F.col("n_train") * F.col("n_test") / (F.col("n_train") + F.col("n_test")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, i: acc + F.pow(F.lit(-1.0), i - 1) * F.exp(-2 * lam * lam * i * i),
    )
    p = F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))
    return d.withColumn("p_value", p).withColumn("keep", (F.col("p_value") >= level).cast("int"))


def winsorise(df: DataFrame, col: str, z: float = 3.0, out: str | None = None) -> DataFrame:
    """Values beyond z deviations become the largest (smallest) value within them."""
    m = df.withColumn("_s", df.agg(F.struct(F.avg(col).alias("m"), F.stddev(col).alias("s")).alias("s")).scalar())
    m = m.withColumn("_z", ratio(c(col) - F.col("_s.m"), F.col("_s.s")))
    b = m.agg(
        F.struct(F.max(F.when(F.col("_z") <= z, c(col))).alias("hi"), F.min(F.when(F.col("_z") >= -z, c(col))).alias("lo")).alias("b")
    ).scalar()
    m = m.withColumn("_b", b)
    fixed = F.when(F.col("_z") > z, F.col("_b.hi")).when(F.col("_z") < -z, F.col("_b.lo")).otherwise(c(col))
    return m.withColumn(out or col, fixed).drop("_s", "_z", "_b")


def prediction_correlation(pred: DataFrame, earlier: Sequence[tuple[str, DataFrame]], key: str, col: str) -> DataFrame:
    """Correlation of a prediction with earlier ones, joined by key."""
    j = pred.select(key, c(col).alias("_p"))
    for name, d in earlier:
        j = j.join(d.select(key, c(col).alias(name)), key)
    items = [F.struct(F.lit(n).alias("model"), no_nan(F.corr("_p", n)).alias("corr")) for n, _ in earlier]
    return j.agg(F.array(*items).alias("a")).select(F.inline("a"))


def binary_or_numeric(df: DataFrame, cols: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(feature, kind): binary for exactly two distinct values, categorical by name, else numeric.

    Two distinct values means that nothing lies strictly between smallest and
    largest, which needs no distinct count.
    """
    wide = df.agg(F.struct(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(x) for x in cols]).alias("s")).scalar()
    src = df.withColumn("_s", wide)
    items = []
    for x in cols:
        lo, hi = F.col(f"_s.{x}.lo"), F.col(f"_s.{x}.hi")
        between = F.count_if((c(x) > lo) & (c(x) < hi))
        two = (between == 0) & (F.min(x) < F.max(x))
        kind = F.lit("categorical") if x in categorical else F.when(two, "binary").otherwise("numeric")
        items.append(F.struct(F.lit(x).alias("feature"), kind.alias("kind")))
    return src.agg(F.array(*items).alias("a")).select(F.inline("a"))


def narrowest_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, target type) from the value range; whole columns narrow to byte..bigint, floats to float."""
    kinds = dict(df.dtypes)
    items = []
    for x in cols:
        lo, hi = F.min(x).cast("double"), F.max(x).cast("double")
        if kinds[x] in ("float", "double"):
            t = F.when((lo > -3.4028235e38) & (hi < 3.4028235e38), "float").otherwise("double")
        else:
            t = (
                F.when((lo > -128) & (hi < 127), "tinyint")
                .when((lo > -32768) & (hi < 32767), "smallint")
                .when((lo > -2147483648) & (hi < 2147483647), "int")
                .otherwise("bigint")
            )
        items.append(F.struct(F.lit(x).alias("feature"), t.alias("target")))
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def downcast(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    target = {r["feature"]: r["target"] for r in narrowest_types(df, cols).collect()}
    return df.withColumns({x: c(x).cast(t) for x, t in target.items()})
