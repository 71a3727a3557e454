"""Ranks, running totals and exact quantiles without a global sort in one task.

Rows are first added up per distinct value. The value axis is then cut into
buckets by approximate quantiles; a window runs inside each bucket and the
bucket totals, one row per bucket, carry the offset across buckets. No task
sees more than one bucket, however skewed the values or the groups are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import has_all
from ..session import cut
from .attach import SIZE, attach, group_size

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 20_000
PER_BUCKET = 50


def value_edges(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Inner bucket edges, at most ``MAX_BUCKETS``; none for small inputs, which only get counted.

    Buckets hold rows added up per value, so the edges are even steps through a
    hashed sample of the distinct values, about ``PER_BUCKET`` for each bucket.
    """
    src = df.where(F.col(value).isNotNull())
    n = src.count()
    m = min(MAX_BUCKETS, -(-n // rows_per_bucket))
    if m <= 1:
        return []
    number = F.col(value).cast("double")
    one_in = max(1, n // (PER_BUCKET * m))
    sample = src.where(F.pmod(F.xxhash64(number), F.lit(one_in)) == 0).select(number.alias("v")).distinct()
    seen = sorted(r["v"] for r in sample.collect() if r["v"] == r["v"])
    return sorted({seen[i * len(seen) // m] for i in range(1, m)}) if seen else []


def with_bucket(df: DataFrame, value: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket number by binary search over literal edges."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *edges, float("inf")]
    tmp = df.withColumn("_cut_in", F.col(value).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_cut_in", outputCol="_cut_out", handleInvalid="keep").transform(tmp)
    return b.withColumn(out, F.col("_cut_out").cast("int")).drop("_cut_in", "_cut_out")


def running_totals(
    df: DataFrame,
    value: str,
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    keep: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """One row per (by, value): measures (sums or counts) and ``<m>_before``, their total over smaller values.

    Without ``by``, ``keep`` may name the stretches of the running total that
    matter, as a condition on the first measure before and after a bucket; the
    other buckets are not sorted.
    """
    by = list(by)
    src = df.where(F.col(value).isNotNull() & has_all(by))
    edges = value_edges(src, value, rows_per_bucket)
    per = src.groupBy(*by, value).agg(*[m.alias(k) for k, m in measures.items()])
    if not edges and by:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return per.withColumns({f"{k}_before": F.coalesce(F.sum(k).over(w), F.lit(0)) for k in measures})
    per = with_bucket(per, value, edges)
    if not edges:
        inner = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return per.withColumns({f"{k}_before": F.coalesce(F.sum(k).over(inner), F.lit(0)) for k in measures}).drop("_bucket")
    # One row per bucket and group: small enough for a plain window.
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = (
        per.groupBy(*by, "_bucket")
        .agg(*[F.sum(k).alias(f"{k}_t") for k in measures])
        .withColumns({f"{k}_off": F.coalesce(F.sum(f"{k}_t").over(outer), F.lit(0)) for k in measures})
    )
    if not by:
        n = next(iter(measures))
        if keep is not None:
            offs = offs.where(keep(F.col(f"{n}_off"), F.col(f"{n}_off") + F.col(f"{n}_t")))
        offs = F.broadcast(offs)  # at most MAX_BUCKETS rows
    per = per.join(offs.drop(*[f"{k}_t" for k in measures]), [*by, "_bucket"])
    inner = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = {f"{k}_before": F.coalesce(F.sum(k).over(inner), F.lit(0)) + F.col(f"{k}_off") for k in measures}
    return per.withColumns(running).drop("_bucket", *[f"{k}_off" for k in measures])


def ranked(
    df: DataFrame,
    value: str,
    outs: Mapping[str, str],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Attach ascending ranks of ``value``: ``outs`` maps a name to how equal values share
    a rank, ``average`` or ``min``."""
    pos = running_totals(df, value, {"_n": F.count(F.lit(1))}, by, rows_per_bucket)
    low = F.col("_n_before") + 1
    kinds = {"average": low + (F.col("_n") - 1) / 2, "min": low}
    ranks = [kinds[k].cast("double").alias(n) for n, k in outs.items()]
    return attach(df, pos.select(*by, value, *ranks, F.col("_n").alias(SIZE)), [*by, value])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (by, q)."""
    by = list(by)
    total = df.agg(F.count(value)).scalar()
    keep = lambda first, past: _candidates(probs, first, past, total)[1]
    pos = running_totals(df, value, {"_n": F.count(F.lit(1))}, by, rows_per_bucket, None if by else keep)
    if by:
        pos = attach(pos, pos.groupBy(*by).agg(F.sum("_n").alias("_total"), group_size()), by)
    else:
        pos = pos.withColumn("_total", total)
    place = lambda q: q * (F.col("_total") - 1)
    first, past = F.col("_n_before"), F.col("_n_before") + F.col("_n")
    lo_in = lambda q: (F.floor(place(q)) >= first) & (F.floor(place(q)) < past)
    hi_in = lambda q: (F.ceil(place(q)) >= first) & (F.ceil(place(q)) < past)
    targets, possible = _candidates(probs, first, past, F.col("_total"))
    # almost all values go by plain arithmetic before any array is built
    hits = pos.where(possible).withColumn("_t", F.filter(targets, lambda q: lo_in(q) | hi_in(q)))
    hits = hits.withColumn("_t", F.explode("_t"))
    t = F.col("_t")
    lo = F.when(lo_in(t), F.col(value).cast("double"))
    hi = F.when(hi_in(t), F.col(value).cast("double"))
    return (
        hits.withColumns({"_lo": lo, "_hi": hi, "_f": place(t) - F.floor(place(t)), "q": t})
        .groupBy(*by, "q")
        .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_f").alias("_f"))
        .select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
    )


def _candidates(probs: Sequence[float], first: Column, past: Column, total: Column) -> tuple[Column, Column]:
    """Probabilities whose position may fall on this value, and whether there can be any.

    A position hits when it lies strictly between ``first - 1`` and ``past``. On
    an even grid i/m that is arithmetic on i; other lists are tried one by one.
    """
    probs = sorted({float(p) for p in probs})
    m = round(1 / (probs[1] - probs[0])) if len(probs) > 8 else 0
    if not m or any(p != i / m for p, i in zip(probs, range(round(probs[0] * m), m + 1))):
        near = [(F.lit(p) * (total - 1) > first - 1) & (F.lit(p) * (total - 1) < past) for p in probs]
        return F.array(*[F.lit(p) for p in probs]), reduce(or_, near)
    per = F.lit(float(m)) / F.greatest(total - 1, F.lit(1))
    # a hair wider than exact, the caller tests each candidate again
    low = F.greatest(F.lit(round(probs[0] * m)), F.floor((first - 1) * per - 1e-6).cast("int") + 1)
    high = F.least(F.lit(round(probs[-1] * m)), F.ceil(past * per + 1e-6).cast("int") - 1)
    return F.transform(F.sequence(low, high), lambda i: i / F.lit(m)), low <= high


def quantile_list(df: DataFrame, value: str, probs: Sequence[float], **kw) -> list[float]:
    """The same as a driver-side list; its length is that of ``probs``."""
    rows = exact_quantiles(df, value, probs, **kw).collect()
    return [q for _, q in sorted((r["q"], r["quantile"]) for r in rows)]


def dense_codes(values: DataFrame, order: Sequence[str], out: str = "code") -> DataFrame:
    """Consecutive codes from 0 in sort order for a table of distinct rows.

    The table is range-sorted and written once; each partition then numbers its
    own rows and adds the sizes of the partitions before it.
    """
    done = cut(values.orderBy(*order))
    numbered = done.withColumns(
        {"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offs = offs.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    # at most one row per partition
    return numbered.join(F.broadcast(offs), "_p").withColumn(out, F.col("_off") + F.col("_i")).drop("_p", "_i", "_off")
