"""Ordered windows per entity that survive a hot entity.

A window over an entity sends all its rows to one task. Entities above
``rows_per_split`` rows are therefore cut into slices by rows; every slice also
gets copies of the few rows before and after it that lags and leads reach for
(the halo), and the copies are dropped afterwards. Entities below the limit are
one slice. Whether any entity is above it is asked once, when the plan is
built; without one the plan is the plain window. Frames over days or hours work
on totals per (entity, day), whose size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, day_number, epoch_micros, has_all, no_nan, ratio
from ..session import cut
from .attach import SIZE, attach, group_size

ROWS_PER_SPLIT = 1_000_000
HOUR = 3_600_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_split: int) -> DataFrame:
    """Keys above the limit with their size."""
    return df.where(has_all(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_split)


def hot_table(df: DataFrame, keys: Sequence[str], rows_per_split: int | None) -> DataFrame | None:
    """The hot keys as a checkpointed table, or None. Fewer rows than the limit need no look at the keys, no limit (None) not even at the rows."""
    if rows_per_split is None or df.count() <= rows_per_split:
        return None
    hot = cut(hot_keys(df, keys, rows_per_split))
    return None if hot.isEmpty() else hot


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_split: int | None = ROWS_PER_SPLIT) -> tuple[DataFrame, bool]:
    """Add ``_slice``: 0 for ordinary keys, ranges of about equal numbers of rows from 1 up for hot ones; and tell whether there are any.

    The rows of hot keys are dealt by ranges of (keys, order) and written once, so
    that a burst at one time, or many rows without a time, is cut like any other.
    """
    keys = list(keys)
    hot = hot_table(df, keys, rows_per_split)
    if hot is None:
        return df.withColumn("_slice", F.lit(0).cast("long")), False
    pieces = max(2, -(-2 * hot.agg(F.sum("_n")).first()[0] // rows_per_split))
    names = hot.select(*keys)
    rows = df.join(names, keys, "left_semi").repartitionByRange(pieces, *keys, *order)
    rows = cut(rows.withColumn("_p", F.spark_partition_id()))
    # one row per key and range
    number = rows.select(*keys, "_p").distinct()
    number = number.withColumn("_slice", F.row_number().over(Window.partitionBy(*keys).orderBy("_p")).cast("long"))
    rows = rows.join(number, [*keys, "_p"]).select(*df.columns, "_slice")
    rest = df.join(names, keys, "left_anti").withColumn("_slice", F.lit(0).cast("long"))
    return rest.select(*df.columns, "_slice").unionByName(rows), True


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int) -> DataFrame:
    """Rows of sliced keys plus the ``before``/``after`` rows each slice needs from its neighbours (``_halo``)."""
    keys, order = list(keys), list(order)
    hot = df.where(F.col("_slice") > 0)
    up = Window.partitionBy(*keys, "_slice").orderBy(*order)
    down = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(x) for x in order])
    # slices that exist, numbered per key, with the rows up to their start
    per = hot.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    k = Window.partitionBy(*keys).orderBy("_slice")
    per = per.withColumns(
        {"_ord": F.row_number().over(k), "_start": F.coalesce(F.sum("_c").over(k.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    parts = [df.withColumn("_halo", F.lit(False))]
    if before:
        tail = hot.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= before)
        tail = tail.join(per, [*keys, "_slice"]).withColumn("_pos", F.col("_start") + F.col("_c") - F.col("_r") + 1)
        parts.append(_copies(tail, per, keys, df.columns, before, forward=True))
    if after:
        head = hot.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= after)
        head = head.join(per, [*keys, "_slice"]).withColumn("_pos", F.col("_start") + F.col("_r"))
        parts.append(_copies(head, per, keys, df.columns, after, forward=False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _copies(edge, per, keys, columns, reach, forward) -> DataFrame:
    """Send an edge row to the following (or preceding) slices that lie within reach."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    sign = 1 if forward else -1
    moved = edge.drop("_start", "_c", "_r").withColumn("_k", steps).withColumn("_ord", F.col("_ord") + sign * F.col("_k"))
    target = per.withColumnRenamed("_slice", "_to")
    hit = moved.join(target, [*keys, "_ord"])
    gap = F.col("_start") + 1 - F.col("_pos") if forward else F.col("_pos") - (F.col("_start") + F.col("_c"))
    hit = hit.where(gap <= reach).withColumn("_slice", F.col("_to"))
    return hit.select(*columns).withColumn("_halo", F.lit(True))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, callable],
    before: int = 1,
    after: int = 0,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` rows away.

    ``exprs`` maps a name to a function of the window, e.g.
    ``lambda w: F.lag("ts", 1).over(w)``. ``order`` starts with the time column
    and ends with an id, so that it is total. Rows with a missing key belong to
    no entity: they stay, with NULL in the new columns.
    """
    full = df.where(has_all(keys))
    parts, any_hot = sliced(full, keys, order, rows_per_split)
    if any_hot:
        parts = with_halo(parts, keys, order, before, after)
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        out = parts.withColumns({k: f(w) for k, f in exprs.items()})
        out = out.where(~F.col("_halo")).drop("_halo", "_slice")
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        out = full.withColumns({k: f(w) for k, f in exprs.items()})
    return out.unionByName(df.where(~has_all(keys)), allowMissingColumns=True)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no", rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Row number per key in an explicit order; slice offsets make it exact for hot keys."""
    s, any_hot = sliced(df.where(has_all(keys)), keys, order, rows_per_split)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    if not any_hot:
        return s.withColumn(out, F.row_number().over(w)).drop("_slice")
    per = s.where(F.col("_slice") > 0).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    k = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.sum("_c").over(k)).drop("_c")
    s = s.withColumn(out, F.row_number().over(w)).join(offs, [*keys, "_slice"], "left")
    return s.withColumn(out, F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).drop("_off", "_slice")


def day_gaps(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, reach: int = 5, **kw) -> DataFrame:
    """Whole days from the row to its previous and next rows, and between the first
    neighbour and the further ones (``past_*`` and ``future_*``)."""
    exprs = {}
    for i in range(1, reach + 1):
        exprs[f"_p{i}"] = lambda w, i=i: F.lag(ts, i).over(w)
        exprs[f"_m{i}"] = lambda w, i=i: F.lead(ts, i).over(w)
    out = ordered(df, keys, [ts, id_col], exprs, reach, reach, **kw)
    days = lambda a, b: F.floor((epoch_micros(a) - epoch_micros(b)) / 86_400_000_000)
    cols = {}
    for i in range(1, reach + 1):
        cols[f"past_p{i}_diff"] = days(ts, f"_p{i}")
        cols[f"future_m{i}_diff"] = days(ts, f"_m{i}")
    for i in range(2, reach + 1):
        cols[f"past_p1_p{i}_diff"] = days("_p1", f"_p{i}")
        cols[f"future_m1_m{i}_diff"] = days("_m1", f"_m{i}")
    return out.withColumns(cols).drop(*[f"_{s}{i}" for s in "pm" for i in range(1, reach + 1)])


def time_differences(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, reach: int = 3, **kw) -> DataFrame:
    """Seconds back to the k-th previous row for k = 1..reach, and ratios of neighbouring differences."""
    exprs = {f"_l{i}": (lambda w, i=i: F.lag(ts, i).over(w)) for i in range(1, reach + 1)}
    out = ordered(df, keys, [ts, id_col], exprs, reach, 0, **kw)
    gap = lambda i: (epoch_micros(ts) - epoch_micros(f"_l{i}")) / 1_000_000
    out = out.withColumns({f"diff{i}": gap(i) for i in range(1, reach + 1)})
    out = out.withColumns({f"diff{i}_per_diff{i + 1}": ratio(f"diff{i}", f"diff{i + 1}") for i in range(1, reach)})
    return out.drop(*[f"_l{i}" for i in range(1, reach + 1)])


def jump_flags(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outs: Mapping[str, str], threshold: str | Column, **kw
) -> DataFrame:
    """1 where value / |previous value| exceeds the row's own threshold; the first row compares with itself.

    ``outs`` maps the flag's name to the value column; all flags share one window.
    """
    lags = {f"_p{i}": (lambda w, v=v: F.lag(v, 1).over(w)) for i, v in enumerate(outs.values())}
    d = ordered(df, keys, order, lags, 1, 0, **kw)
    step = lambda v, p: ratio(c(v), F.abs(F.coalesce(F.col(p), c(v))))
    flags = {
        k: F.coalesce((step(v, f"_p{i}") > c(threshold)).cast("int"), F.lit(0)) for i, (k, v) in enumerate(outs.items())
    }
    return d.withColumns(flags).drop(*lags)


# -- frames over days and hours -------------------------------------------------


def daily_totals(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str] = ()) -> DataFrame:
    """Rows, and sum, count and max of each value, per (keys, day)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for v in values:
        aggs += [
            F.sum(v).alias(f"_{v}_s"),
            F.count(v).alias(f"_{v}_c"),
            F.max(v).alias(f"_{v}_x"),
        ]
    return df.where(has_all([*keys, ts])).groupBy(*keys, day_number(ts).alias("_day")).agg(*aggs)


def _frame(keys: Sequence[str], n: int):
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day")
    return w.rangeBetween(-n, 0) if n >= 0 else w.rangeBetween(0, -n)


def window_days(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, days: Sequence[int], stats: Sequence[str] = ("mean",), sized=False
) -> DataFrame:
    """Per active (keys, day): mean, sum, max or count of ``value`` over ``[day-n, day]``.

    Negative n looks forward over ``[day, day+n]``. Both ends belong to the
    window. Means are sum over count of the rows, not a mean of daily means.
    """
    d = daily_totals(df, keys, ts, [value])
    make = {
        "mean": lambda w: F.try_divide(F.sum(f"_{value}_s").over(w), F.sum(f"_{value}_c").over(w)),
        "sum": lambda w: F.sum(f"_{value}_s").over(w),
        "max": lambda w: F.max(f"_{value}_x").over(w),
        "count": lambda w: F.sum("_rows").over(w),
    }
    named = {f"day{n}_{value}_{s}".replace("-", "m"): make[s](_frame(keys, n)) for n in days for s in stats}
    size = [F.col("_rows").alias(SIZE)] if sized else []
    return d.withColumns(named).select(*keys, "_day", *named, *size)


def attach_window_days(df, keys, ts, value, days, stats=("mean",), relative: bool = True) -> DataFrame:
    """Attach ``window_days`` to the rows, with ratio and difference to the row's own value."""
    feats = window_days(df, keys, ts, value, days, stats, sized=True)
    names = feats.columns[len(keys) + 1 : -1]
    out = attach(df.withColumn("_day", day_number(ts)), feats, [*keys, "_day"]).drop("_day")
    if relative:
        for n in names:
            out = out.withColumns({f"{n}_org_ratio": ratio(n, value, 1), f"{n}_org_diff": F.col(n) - F.col(value)})
    return out


def window_hours(
    df: DataFrame, keys: Sequence[str], ts: str, hours: Sequence[int], anchor_keys: Sequence[str] | None = None
) -> DataFrame:
    """Per active (keys, hour): rows within n hours before (after, for n < 0) the last event of the hour.

    The last event is taken per ``anchor_keys`` (the keys themselves by default,
    ``[]`` for the last event of anyone). Whole hours are summed from hourly
    totals; the one hour cut by the window's far end is counted against the offset
    of its anchor. The offsets of all anchors an hour is asked for stand beside it
    as columns, so that every row is read once and all counts of an hour are
    conditional sums, added up before the shuffle.
    """
    keys = list(keys)
    anchor_keys = keys if anchor_keys is None else list(anchor_keys)
    src = df.where(has_all([*keys, ts])).select(*keys, epoch_micros(ts).alias("_us"))
    src = src.withColumn("_h", F.floor(F.col("_us") / HOUR))
    src = src.withColumn("_o", F.col("_us") - F.col("_h") * HOUR).drop("_us")
    anchor = src.groupBy(*anchor_keys, "_h").agg(F.max("_o").alias("_a"), group_size())
    steps = [0, *hours]
    asks = anchor.select(*anchor_keys, "_h", "_a", F.explode(F.array(*map(F.lit, steps))).alias("_k"))
    asks = asks.withColumn("_h", F.col("_h") - F.col("_k")).groupBy(*anchor_keys, "_h").pivot("_k", steps).agg(F.first("_a"))
    asks = asks.withColumnsRenamed({str(k): f"_a{i}" for i, k in enumerate(steps)})
    rows = attach(src, anchor.select(*anchor_keys, "_h", SIZE).join(asks, [*anchor_keys, "_h"]), [*anchor_keys, "_h"])

    def near(i: int, k: int) -> Column:
        """Rows on the near side of the offset of the anchor k hours later (earlier)."""
        return F.count_if(F.col("_o") >= F.col(f"_a{i}") if k >= 0 else F.col("_o") <= F.col(f"_a{i}")).alias(f"_c{i}")

    out = rows.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"), *[near(i, k) for i, k in enumerate(steps)])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_h")
    counts = {}
    for i, n in enumerate(hours, start=1):
        # the anchor's own hour: all of it backwards, the last instant forwards
        whole = F.sum("_n").over(w.rangeBetween(-(n - 1), 0)) if n > 0 else F.col("_c0")
        if n < -1:
            whole = whole + F.coalesce(F.sum("_n").over(w.rangeBetween(1, -n - 1)), F.lit(0))
        edge = F.coalesce(F.sum(f"_c{i}").over(w.rangeBetween(-n, -n)), F.lit(0))
        counts[f"hour{n}_count".replace("-", "m")] = whole + edge
    return out.withColumns(counts).select(*keys, F.col("_h").alias("hour_no"), *counts)


def next_period_ratio(df: DataFrame, keys: Sequence[str], period: str, out: str) -> DataFrame:
    """Rows of the key in the next period over its rows in this one plus one.

    Both sides come from one (keys, period) table; the number of periods per key is bounded.
    """
    cell = df.where(has_all([*keys, period])).groupBy(*keys, period).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(period)
    nxt = F.when(F.lead(period).over(w) == F.col(period) + 1, F.lead("_n").over(w))
    return cell.withColumn(out, F.coalesce(nxt, F.lit(0)) / (F.col("_n") + 1)).drop("_n")


# -- relative to the group --------------------------------------------------------


def relative_to_group(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Value over the group's mean and over its standard deviation."""
    aggs = []
    for x in cols:
        aggs += [F.avg(x).alias(f"_{x}_m"), no_nan(F.stddev(x)).alias(f"_{x}_s")]
    out = attach(df, df.where(has_all(keys)).groupBy(*keys).agg(*aggs, group_size()), keys)
    for x in cols:
        out = out.withColumns({f"{x}_to_mean": ratio(x, f"_{x}_m"), f"{x}_to_std": ratio(x, f"_{x}_s")})
    return out.drop(*[f"_{x}_{s}" for x in cols for s in "ms"])


def group_zscore(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    per = df.where(has_all(keys)).groupBy(*keys)
    per = per.agg(F.avg(col).alias("_m"), no_nan(F.stddev(col)).alias("_s"), group_size())
    j = attach(df, per, keys)
    return j.withColumn(out, ratio(F.col(col) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def period_scaling(df: DataFrame, period: str, cols: Sequence[str]) -> DataFrame:
    """Min-max and z-score of each column within the period."""
    aggs = []
    for x in cols:
        aggs += [F.min(x).alias(f"_{x}_lo"), F.max(x).alias(f"_{x}_hi"), F.avg(x).alias(f"_{x}_m"), no_nan(F.stddev(x)).alias(f"_{x}_s")]
    out = attach(df, df.where(has_all([period])).groupBy(period).agg(*aggs), [period], few=True)
    for x in cols:
        lo, hi = F.col(f"_{x}_lo"), F.col(f"_{x}_hi")
        out = out.withColumns(
            {
                f"{x}_min_max": ratio(F.col(x) - lo, hi - lo),
                f"{x}_std_score": ratio(F.col(x) - F.col(f"_{x}_m"), F.col(f"_{x}_s")),
            }
        )
    return out.drop(*[f"_{x}_{s}" for x in cols for s in ("lo", "hi", "m", "s")])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order, by aggregation instead of a sort."""
    rest = [x for x in df.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")
