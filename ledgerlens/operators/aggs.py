"""Grouped statistics: one aggregation per key set, joined back by key.

Every statistic here is algebraic, so hot keys are added up before the
shuffle. Rows get their group's statistics through ``attach``, never through a
window over the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, has_all, no_nan, ratio
from .attach import FEW, SIZE, attach, group_size
from .ordering import exact_quantiles


def skew(x: str | Column) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for constant ones."""
    x = c(x)
    n = F.count(x).cast("double")
    raw = F.coalesce(no_nan(F.skewness(x)), F.lit(0.0))
    return F.when(n > 2, raw * F.sqrt(n * (n - 1)) / (n - 2))


STATS = {
    "mean": lambda x: F.avg(x),
    "sum": lambda x: F.sum(x),
    "max": lambda x: F.max(x),
    "min": lambda x: F.min(x),
    "std": lambda x: no_nan(F.stddev(x)),
    "count": lambda x: F.count(x),
    "range": lambda x: F.max(x) - F.min(x),
    "skew": skew,
}


def stat_columns(spec: Mapping[str, Sequence[str]], prefix: str = "") -> list[Column]:
    return [STATS[s](c(col)).alias(f"{prefix}{col}_{s}") for col, stats in spec.items() for s in stats]


def group_stats(
    df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]], prefix: str = "", keep_null: bool = False
) -> DataFrame:
    """All statistics of all columns for one key set in a single aggregation."""
    src = df if keep_null else df.where(has_all(keys))
    return src.groupBy(*keys).agg(*stat_columns(spec, prefix))


def sized_stats(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]], prefix: str = "") -> DataFrame:
    """``group_stats`` with the group size, ready for ``attach``."""
    return df.where(has_all(keys)).groupBy(*keys).agg(*stat_columns(spec, prefix), group_size())


def attach_group_stats(
    df: DataFrame, keysets: Sequence[Sequence[str]], spec: Mapping[str, Sequence[str]], few: bool = False
) -> DataFrame:
    """Statistics of several key sets; ``few`` when every key set has a short list of values.

    Then one pass with grouping sets serves all of them and the tables are
    broadcast; more than FEW groups in all fall back to one join per key set.
    """
    out = df
    small = _few_tables(df, keysets, spec) if few else None
    if small is not None:
        for keys, table in zip(keysets, small):
            out = attach(out, F.broadcast(table), keys)
        return out
    for keys in keysets:
        name = "-".join(keys) + "__"
        out = attach(out, sized_stats(df, keys, spec, prefix=name), keys)
    return out


def _few_tables(df: DataFrame, keysets: Sequence[Sequence[str]], spec) -> list[DataFrame] | None:
    every = list(dict.fromkeys(k for keys in keysets for k in keys))
    sets = df.groupingSets([[F.col(k) for k in keys] for keys in keysets], *every)
    table = sets.agg(*stat_columns(spec), F.grouping_id().alias("_g"))
    rows = table.limit(FEW + 1).collect()
    if len(rows) > FEW:
        return None
    local, out = df.sparkSession.createDataFrame(rows, table.schema), []
    for keys in keysets:
        gid = sum(2 ** (len(every) - 1 - i) for i, k in enumerate(every) if k not in keys)
        name = "-".join(keys) + "__"
        mine = local.where((F.col("_g") == gid) & has_all(keys))
        out.append(mine.select(*keys, *[F.col(x).alias(f"{name}{x}") for x in table.columns if x not in [*every, "_g"]]))
    return out


def key_combinations(keys: Sequence[str], low: int, high: int) -> list[list[str]]:
    return [list(x) for n in range(low, high + 1) for x in combinations(keys, n)]


def combination_stats(df: DataFrame, keys: Sequence[str], low: int, high: int, spec, few: bool = False) -> DataFrame:
    return attach_group_stats(df, key_combinations(keys, low, high), spec, few)


def counts(df: DataFrame, keys: Sequence[str], out: str = "n", null_token: bool = True) -> DataFrame:
    """Attach the size of each row's key; missing values count as a value."""
    src = df if null_token else df.where(has_all(keys))
    per = src.groupBy(*keys).agg(F.count(F.lit(1)).alias(out), group_size())
    return attach(df, per, keys, null_safe=null_token)


def sentinel_count(df: DataFrame, col: str, drop: bool = True, few: bool = False) -> DataFrame:
    """``cnt__col`` with missing values under a sentinel (``#`` or -98765); the column itself goes."""
    kind = dict(df.dtypes)[col]
    fill = F.lit("#") if kind == "string" else F.lit(-98765).cast(kind)
    src = df.withColumn("_k", F.coalesce(c(col), fill))
    per = src.groupBy("_k").agg(F.count(F.lit(1)).alias(f"cnt__{col}"), group_size())
    out = attach(src, per, ["_k"], few=few).drop("_k")
    return out.drop(col) if drop else out


def period_share(df: DataFrame, value: str, period: str, out: str) -> DataFrame:
    """Rows with this value in the period over all rows of the period."""
    cell = df.groupBy(value, period).agg(group_size())
    total = df.groupBy(period).agg(F.count(F.lit(1)).alias("_t"))
    cell = attach(cell, total, [period], few=True, null_safe=True)
    cell = cell.select(value, period, SIZE, ratio(SIZE, "_t").alias(out))
    return attach(df, cell, [value, period], null_safe=True)


def period_profile(df: DataFrame, value: str, period: str, periods: Sequence, prefix: str = "p") -> DataFrame:
    """One row per value: its count in each period and that count over its total, from one aggregate."""
    hits = [F.count_if(c(period) == F.lit(p)) for p in periods]
    named = [x.alias(f"{prefix}_{p}_cnt") for x, p in zip(hits, periods)]
    per = df.where(has_all([value])).groupBy(value).agg(F.count(F.lit(1)).alias("_t"), *named)
    shares = [ratio(F.col(f"{prefix}_{p}_cnt"), F.col("_t")).alias(f"{prefix}_{p}_ratio") for p in periods]
    return per.select(value, *[f"{prefix}_{p}_cnt" for p in periods], *shares)


def category_share(df: DataFrame, keys: Sequence[str], cat: str, out: str = "share") -> DataFrame:
    """One row per (keys, category): its share of the group's non-null categories."""
    cell = df.where(has_all([*keys, cat])).groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("cnt"))
    total = cell.groupBy(*keys).agg(F.sum("cnt").alias("_t"), group_size())
    return attach(cell, total, keys).withColumn(out, ratio("cnt", "_t")).drop("_t")


def category_share_wide(df: DataFrame, keys: Sequence[str], cat: str, levels: Sequence, prefix: str) -> DataFrame:
    """Shares as one column per level; a level that does not occur stays NULL."""
    n = F.count(cat)
    hits = [F.sum((F.col(cat) == F.lit(v)).cast("int")) for v in levels]
    return (
        df.where(has_all([*keys, cat]))
        .groupBy(*keys)
        .agg(*[F.when(h > 0, ratio(h, n)).alias(f"{prefix}_{v}") for h, v in zip(hits, levels)])
    )


def category_variety(df: DataFrame, keys: Sequence[str], cat: str) -> DataFrame:
    """Per (keys, category): rows, distinct categories of the group, and their ratio."""
    cell = df.where(has_all([*keys, cat])).groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("n_sample"))
    var = cell.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), group_size())
    return attach(cell, var, keys).withColumn("ratio", ratio("n_total", "n_sample"))


def modal_value(df: DataFrame, col: str, keys: Sequence[str] = (), out: str = "mode") -> DataFrame:
    """Most frequent value, the smallest on ties, and the group size: one row per key (or one row)."""
    cell = df.where(has_all([*keys, col])).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return cell.groupBy(*keys).agg(
        F.min(F.struct(-F.col("_n"), F.col(col).alias("v")))["v"].alias(out), F.sum("_n").alias(SIZE)
    )


def mode_fill(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(c(col), modal_value(df, col).drop(SIZE).scalar()))


def offset_from_mode(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    return attach(df, modal_value(df, col, keys, "_m"), keys).withColumn(out, c(col) - F.col("_m")).drop("_m")


def offset_from_mean(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    per = sized_stats(df, keys, {col: ["mean"]}).withColumnRenamed(f"{col}_mean", "_m")
    return attach(df, per, keys).withColumn(out, c(col) - F.col("_m")).drop("_m")


def category_maxima(df: DataFrame, cat: str, cols: Sequence[str]) -> DataFrame:
    """(column, category, maximum) over many columns in one pass."""
    wide = df.groupBy(cat).agg(*[F.max(c(x).cast("double")).alias(x) for x in cols])
    return wide.unpivot([cat], list(cols), "feature", "max_value")


def label_profile(df: DataFrame, value: str, cat: str, label: str, levels: Sequence) -> DataFrame:
    """Label mean and count by value, one pair of columns per category level."""
    aggs = []
    for lv in levels:
        y = F.when(F.col(cat) == F.lit(lv), c(label))
        aggs += [F.avg(y).alias(f"{lv}_mean"), F.count(y).alias(f"{lv}_cnt")]
    return df.where(has_all([value])).groupBy(value).agg(*aggs)


def mean_by_group_size(df: DataFrame, key: str, label: str) -> DataFrame:
    """Largest and mean group mean per group size."""
    inner = df.where(has_all([key])).groupBy(key).agg(F.count(label).alias("cnt"), F.avg(label).alias("_m"))
    return inner.groupBy("cnt").agg(F.max("_m").alias("max_mean"), F.avg("_m").alias("mean_mean"))


def zscored_daily(df: DataFrame, date: str, value: str) -> DataFrame:
    """Daily count and sum with their z-scores over all days."""
    day = df.where(has_all([date])).groupBy(date).agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("total"))
    s = day.agg(
        F.struct(
            F.avg("cnt").alias("ca"), F.stddev("cnt").alias("cs"), F.avg("total").alias("ta"), F.stddev("total").alias("ts")
        )
    ).scalar()
    return (
        day.withColumn("_s", s)
        .withColumn("cnt_z", ratio(F.col("cnt") - F.col("_s.ca"), F.col("_s.cs")))
        .withColumn("total_z", ratio(F.col("total") - F.col("_s.ta"), F.col("_s.ts")))
        .drop("_s")
    )


def totals_with_all(df: DataFrame, level: str, date: str, aggs: Sequence[Column]) -> DataFrame:
    """Per (level, date) and per date under the level ``all``, from one scan."""
    return (
        df.groupingSets([[level, date], [date]], level, date)
        .agg(*aggs, F.grouping(level).alias("_g"))
        .withColumn(level, F.when(F.col("_g") == 1, F.lit("all")).otherwise(c(level)))
        .drop("_g")
    )


def wrapped_day(day: str | Column, length: int = 365) -> Column:
    """Days beyond ``length`` start again at 1, as often as it takes."""
    return F.when(c(day) > length, F.pmod(c(day) - 1, F.lit(length)) + 1).otherwise(c(day))


def dated_window(df: DataFrame, ts: str, day: str, n_days: int) -> DataFrame:
    """Rows dated before ``day`` and less than ``n_days`` before it, with their ``age`` in days."""
    x = df.withColumn("age", F.datediff(F.lit(day).cast("date"), c(ts)))
    return x.where((F.col("age") > 0) & (F.col("age") < n_days))


def decayed_means(df: DataFrame, keys: Sequence[str], value: str, age: str, rates: Sequence[float]) -> DataFrame:
    """Per group and rate ``mean_i`` and ``compound_i``, whose weights multiply up all rates so far."""
    aggs, rate = [], 1.0
    w = lambda r: F.pow(F.lit(float(r)), c(age))
    for i, a in enumerate(rates):
        rate *= a
        aggs += [
            decayed_mean(value, age, a).alias(f"mean_{i}"),
            F.try_divide(F.sum(c(value) * w(rate)), F.sum(F.when(c(value).isNotNull(), w(a)))).alias(f"compound_{i}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def weekday_stats(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """min, mean, median, max, count, std and skew per group; std and skew are 0 where undefined.

    The median goes by buckets of values, so that no task holds the values of a group.
    """
    x = df.withColumns({"_v": c(value).cast("double"), "_k": F.to_json(F.struct(*keys))})
    v = F.col("_v")
    n, skew = F.count(v), no_nan(F.skewness(v))
    # Adjusted for the sample size, as undefined below three rows.
    adjusted = skew * F.sqrt(n * (n - 1).cast("double")) / (n - 2)
    stats = x.groupBy("_k", *keys).agg(
        F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), n.alias("count"),
        F.coalesce(no_nan(F.stddev(v)), F.lit(0.0)).alias("std"), F.coalesce(F.when(n > 2, adjusted), F.lit(0.0)).alias("skew"),
    )
    middle = exact_quantiles(x.select("_k", "_v"), "_v", [0.5], ["_k"], **kw).select("_k", F.col("quantile").alias("median"))
    return stats.join(middle, "_k", "left").select(*keys, "min", "mean", "median", "max", "count", "std", "skew")


def decayed_mean(value: str | Column, age: str | Column, rate: float) -> Column:
    """``sum(x * rate^age) / sum(rate^age)`` as an aggregate."""
    w = F.when(c(value).isNotNull(), F.pow(F.lit(float(rate)), c(age)))
    return F.try_divide(F.sum(c(value) * w), F.sum(w))


def day_changes(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Change between consecutive *calendar columns* of the key's daily series: mean of
    absolute changes, std, max and min. Days come from all keys, so a day on which the
    key is absent breaks the chain on both sides."""
    daily = df.where(has_all([*keys, date])).groupBy(*keys, date).agg(F.sum(value).alias("_v"))
    # one sorted array of days, bounded by the calendar
    days = daily.agg(F.sort_array(F.collect_set(date))).scalar()
    daily = daily.withColumn("_days", days).withColumn("_i", F.array_position("_days", F.col(date))).drop("_days")
    k = Window.partitionBy(*keys).orderBy("_i")
    prev = F.lag("_v").over(k)
    adjacent = F.lag("_i").over(k) == F.col("_i") - 1
    chg = daily.withColumn("_d", F.when(adjacent, F.col("_v") - prev))
    return chg.groupBy(*keys).agg(
        F.avg(F.abs("_d")).alias("diff_mean"),
        no_nan(F.stddev("_d")).alias("diff_std"),
        F.max("_d").alias("diff_max"),
        F.min("_d").alias("diff_min"),
    )


def multi_period_entities(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Entities seen in more than one period; pre-aggregated to (entity, period)."""
    cell = df.where(has_all([entity, period])).groupBy(entity, period).agg(F.count(F.lit(1)).alias("_n"))
    per = cell.groupBy(entity).agg(F.count(F.lit(1)).alias("n_periods"), F.sum("_n").alias("n_rows"))
    return per.where(F.col("n_periods") > 1)


def histogram_axis(df: DataFrame, cols: Sequence[str], size: int = 200) -> DataFrame:
    """Value counts of several columns side by side on the axis 0..size-1; empty cells are NULL."""
    spark = df.sparkSession
    long = df.select(*[c(x).cast("double").alias(x) for x in cols]).unpivot([], list(cols), "_f", "_v")
    long = long.where((F.col("_v") == F.floor("_v")) & (F.col("_v") >= 0) & (F.col("_v") < size))
    wide = long.groupBy(F.col("_v").cast("long").alias("bin")).pivot("_f", list(cols)).count()
    return spark.range(size).withColumnRenamed("id", "bin").join(wide, "bin", "left")


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First and last non-null value in time order, their difference and ratio, per key."""
    aggs = []
    for x in cols:
        pos = F.when(c(x).isNotNull(), F.struct(*order))
        aggs += [F.min_by(x, pos).alias(f"{x}_first"), F.max_by(x, pos).alias(f"{x}_last")]
    out = df.where(has_all(keys)).groupBy(*keys).agg(*aggs)
    for x in cols:
        out = out.withColumn(f"{x}_diff", F.col(f"{x}_last") - F.col(f"{x}_first"))
        out = out.withColumn(f"{x}_ratio", ratio(f"{x}_last", f"{x}_first", 10))
    return out
