"""Filters, masks, set forms and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, has_all
from .attach import SIZE, attach, group_size
from .ordering import running_totals


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.where(c(label).isNotNull()), df.where(c(label).isNull())


def members(df: DataFrame, ids: DataFrame, keys: Sequence[str], keep: bool = True) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_semi" if keep else "left_anti")


def split_presence(df: DataFrame, col: str, split: str) -> DataFrame:
    """Rows per value in train and in test."""
    return (
        df.where(has_all([col]))
        .groupBy(col)
        .agg(
            F.sum((c(split) == "train").cast("int")).alias("_tr"),
            F.sum((c(split) == "test").cast("int")).alias("_te"),
            group_size(),
        )
    )


def mask_unshared(df: DataFrame, col: str, split: str, more_than: int = 0, out: str | None = None) -> DataFrame:
    """NULL where the value misses from one split or has at most ``more_than`` rows in all."""
    p = split_presence(df, col, split)
    p = p.where((F.col("_tr") > 0) & (F.col("_te") > 0) & (F.col("_tr") + F.col("_te") > more_than))
    j = attach(df, p.select(col, F.lit(True).alias("_ok"), SIZE), [col])
    return j.withColumn(out or col, F.when(F.col("_ok"), c(col))).drop("_ok")


def in_other_split(df: DataFrame, col: str, split: str, out: str) -> DataFrame:
    """1 where the value also occurs in the other split."""
    p = split_presence(df, col, split)
    j = attach(df, p, [col])
    other = F.when(c(split) == "train", F.col("_te")).otherwise(F.col("_tr"))
    return j.withColumn(out, F.coalesce((other > 0).cast("int"), F.lit(0))).drop("_tr", "_te")


def collapse_rare(df: DataFrame, col: str, below: int = 200, label: str = "others", out: str | None = None) -> DataFrame:
    per = df.where(has_all([col])).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    j = attach(df, per.select(col, (F.col("_n") < below).alias("_rare"), F.col("_n").alias(SIZE)), [col])
    return j.withColumn(out or col, F.when(F.col("_rare"), F.lit(label)).otherwise(c(col))).drop("_rare")


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, null_share) from one aggregate."""
    cols = list(cols or df.columns)
    n = F.count(F.lit(1))
    wide = df.agg(*[((n - F.count(x)) / n).alias(x) for x in cols])
    return wide.unpivot([], cols, "feature", "null_share")


def drop_sparse_columns(df: DataFrame, limit: float = 0.8, cols: Sequence[str] | None = None) -> DataFrame:
    bad = [r["feature"] for r in null_shares(df, cols).where(F.col("null_share") > limit).collect()]
    return df.drop(*bad)


def position_cut(df: DataFrame, order: str, share: float, first: str, rest: str, out: str) -> DataFrame:
    """Name the first ``share`` of the rows by position in ``order`` (unique values)."""
    k = int(df.count() * share)
    hit = lambda a, b: (a <= k) & (b > k)
    pos = running_totals(df, order, {"_n": F.count(F.lit(1))}, keep=hit)
    edge = pos.where(hit(F.col("_n_before"), F.col("_n_before") + F.col("_n"))).agg(F.min(order)).scalar()
    # no edge: everything comes first
    return df.withColumn(out, F.when(F.coalesce(c(order) < edge, F.lit(True)), first).otherwise(rest))


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts per value, most frequent first; with ``n`` only the top of the report."""
    out = df.where(has_all([col])).groupBy(col).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), col)
    return out if n is None else out.limit(n)


def both_split_counts(df: DataFrame, col: str, split: str) -> DataFrame:
    """Value counts of train and test side by side."""
    count = {f"n_{s}": F.count_if(c(split) == s) for s in ("train", "test")}
    out = df.where(has_all([col])).groupBy(col).agg(*[v.alias(k) for k, v in count.items()])
    return out.where("n_train + n_test > 0")


def best_per(df: DataFrame, keys: Sequence[str], score: str | Column, cols: Sequence[str]) -> DataFrame:
    """The row with the best score per key; ties go to the smallest ``cols``."""
    best = F.min(F.struct((-c(score)).alias("_s"), *cols))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{x}").alias(x) for x in cols], (-F.col("_b._s")).alias("best"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of both, aligned by name, with their split as a column."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )
