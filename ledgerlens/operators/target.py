"""Label-mean encodings. The label table is first added up to (key, period), so
everything after that is as small as the number of keys times the periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, has_all, ratio
from .attach import SIZE, attach, group_size

ALL_PERIODS = "test"  # period name under which unlabelled rows find their encoding


def label_mean(df: DataFrame, key: str, label: str, out: str, few: bool = False) -> DataFrame:
    """Mean label of the labelled rows by key, mapped to every row."""
    per = df.where(c(key).isNotNull()).groupBy(key).agg(F.avg(label).alias(out), group_size())
    return attach(df, per, [key], few=few)


def smoothed_label_mean(
    df: DataFrame,
    key: str,
    label: str,
    out: str,
    min_leaf: float = 100,
    smoothing: float = 10,
    noise: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Label mean pulled to the prior where the key is rare; unseen keys get the prior."""
    labelled = df.where(c(label).isNotNull())
    per = df.where(c(key).isNotNull()).groupBy(key)
    per = per.agg(F.avg(label).alias("_m"), F.nullif(F.count(label), F.lit(0)).alias("_n"), group_size())
    weight = F.lit(1.0) / (1 + F.exp(-(F.col("_n") - min_leaf) / smoothing))
    j = attach(df, per, [key]).withColumn("_prior", labelled.agg(F.avg(label)).scalar())
    enc = F.coalesce(F.col("_prior") * (1 - weight) + F.col("_m") * weight, F.col("_prior"))
    if noise:
        enc = enc * (1 + noise * _normal(df.columns, seed))
    return j.withColumn(out, enc).drop("_m", "_n", "_prior")


def _normal(columns: Sequence[str], seed: int) -> Column:
    """A standard normal number per row from hashes of its columns, so that retries and partitions agree."""
    unit = lambda k: (F.xxhash64(*columns, F.lit(seed), F.lit(k)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))


def period_cells(df: DataFrame, keys: Sequence[str], label: str, period: str) -> DataFrame:
    """Label sum and count per (keys, period) over labelled rows."""
    return (
        df.where(c(label).isNotNull() & has_all([*keys, period]))
        .groupBy(*keys, period)
        .agg(F.sum(c(label).cast("double")).alias("_s"), F.count(label).alias("_n"))
    )


def leave_period_out(
    df: DataFrame, keys: Sequence[str], label: str, period: str, out: str, min_count: int = 0
) -> DataFrame:
    """Label mean by key without the row's own period; unlabelled rows use every period.

    Totals minus the own period, so one aggregation serves all periods. With
    ``min_count`` a key with fewer labelled rows gets the overall mean.
    """
    rows = df.withColumn("_p", F.when(c(label).isNotNull(), c(period).cast("string")).otherwise(ALL_PERIODS))
    cells = rows.where(has_all([*keys, "_p"])).groupBy(*keys, "_p").agg(
        F.coalesce(F.sum(c(label).cast("double")), F.lit(0.0)).alias("_s"), F.count(label).alias("_n"), group_size()
    )
    w = Window.partitionBy(*keys)  # at most one row per period
    s, n = F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n")
    enc = cells.withColumns({"_ls": s, "_ln": n})
    mean = F.try_divide("_ls", "_ln")
    if min_count:
        enc = enc.withColumn("_prior", df.agg(F.avg(label)).scalar())
        mean = F.when(F.col("_ln") < min_count, F.when(F.col("_ln") > 0, F.col("_prior"))).otherwise(mean)
    enc = enc.select(*keys, "_p", mean.alias(out), SIZE)
    return attach(rows, enc, [*keys, "_p"]).drop("_p")


def _spread(arr: Column, name: str) -> list[Column]:
    """Range, max/(min+1) and sample std of an array, 0 where undefined."""
    hi, lo = F.array_max(arr), F.array_min(arr)
    n = F.size(arr)
    add = lambda a, b: a + b
    mean = F.aggregate(arr, F.lit(0.0), add) / n
    dev = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2))
    return [
        F.coalesce(hi - lo, F.lit(0.0)).alias(f"{name}_max_min_diff"),
        F.coalesce(ratio(hi, lo, 1), F.lit(0.0)).alias(f"{name}_max_min_ratio"),
        F.when(n > 1, F.sqrt(dev / (n - 1))).otherwise(0.0).alias(f"{name}_std"),
    ]


def proximity_weight(own: Column, other: Column, periods: int) -> Column:
    """Weight of another period. Earlier periods come first, nearest first, then later
    ones, nearest first; weights fall evenly from 1. Without an own period they rise
    evenly with recency from 0.25 to 1."""
    place = F.when(other < own, own - 1 - other).otherwise(other - 1)
    near = 1 - place / F.lit(float(periods - 1))
    recent = 0.25 + 0.75 * other / F.lit(float(periods - 1))
    return F.when(own.isNull(), recent).otherwise(near)


def period_profile_encoding(df: DataFrame, keys: Sequence[str], label: str, period: str, periods: int) -> DataFrame:
    """Label-rate profile of a key over the periods other than the row's own.

    ``period`` is an integer 0..periods-1. One row per (keys, own period), with a
    NULL own period for unlabelled rows. The array of a key holds one entry per
    period, so nothing grows with the rows.
    """
    cells = period_cells(df, keys, label, period)
    entry = F.struct(c(period).cast("int").alias("p"), F.col("_s").alias("s"), F.col("_n").cast("double").alias("n"))
    per = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    own = F.explode(F.concat(F.transform("_all", lambda e: e["p"]), F.array(F.lit(None).cast("int"))))
    x = per.withColumn("own", own)
    x = x.withColumn("_o", F.filter("_all", lambda e: F.col("own").isNull() | (e["p"] != F.col("own"))))
    x = x.where(F.size("_o") > 0)
    tot_s = F.aggregate("_o", F.lit(0.0), lambda a, e: a + e["s"])
    tot_n = F.aggregate("_o", F.lit(0.0), lambda a, e: a + e["n"])
    x = x.withColumn("fraud_all_mean", tot_s / tot_n)
    x = x.withColumn("_m", F.transform("_o", lambda e: e["s"] / e["n"]))
    x = x.withColumn("_r", F.transform("_m", lambda m: m / (F.col("fraud_all_mean") + 1)))
    x = x.withColumn("_w", F.transform("_o", lambda e: proximity_weight(F.col("own"), e["p"], periods)))
    add = lambda a, b: a + b
    wsum = F.aggregate("_w", F.lit(0.0), add)
    wmean = lambda col: F.coalesce(
        F.try_divide(F.aggregate(F.zip_with(col, "_w", lambda a, b: a * b), F.lit(0.0), add), wsum), F.lit(0.0)
    )
    x = x.withColumn("prob_weighted_mean", wmean("_m"))
    return x.select(
        *keys,
        "own",
        "fraud_all_mean",
        F.size(F.filter("_m", lambda m: m == 0)).alias("no_fraud_sum"),
        *_spread(F.col("_m"), "prob"),
        *_spread(F.col("_r"), "ratio"),
        "prob_weighted_mean",
        ratio("prob_weighted_mean", "fraud_all_mean", 1).alias("prob_trend"),
        wmean("_r").alias("ratio_weighted_mean"),
    )


def attach_period_profile(df: DataFrame, keys: Sequence[str], label: str, period: str, periods: int, prefix: str = "") -> DataFrame:
    enc = period_profile_encoding(df, keys, label, period, periods)
    enc = enc.withColumn("own", F.coalesce("own", F.lit(-1)))
    enc = enc.withColumnsRenamed({n: f"{prefix}{n}" for n in enc.columns if n not in [*keys, "own"]})
    rows = df.withColumn("own", F.when(c(label).isNotNull(), c(period).cast("int")).otherwise(-1))
    sizes = rows.where(has_all([*keys, "own"])).groupBy(*keys, "own").agg(group_size())
    return attach(rows, enc.join(sizes, [*keys, "own"]), [*keys, "own"]).drop("own")
