"""Down-sampling, folds and holdouts. Random choices hash the key, so that a
row's fate does not depend on partitions, retries or engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, text
from ..session import cut
from .attach import FEW, SIZE, attach
from .ordering import dense_codes, exact_quantiles


def hash_unit(key: str | Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from the key's md5."""
    return hash_int(key, seed) / F.lit(4294967296.0)


def hash_int(key: str | Column, seed: int = 0) -> Column:
    h = F.md5(F.concat(text(key), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def downsample_negatives(df: DataFrame, label: str, key: str, keep: float = 0.2, seed: int = 0) -> DataFrame:
    return df.where((c(label) == 1) | (hash_unit(key, seed) < keep))


def folds(df: DataFrame, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(hash_int(key, seed), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Rows of each label are dealt round robin in hash order, so fold sizes differ by one at most.

    The order number is the place within one of 65,536 hash ranges plus the rows
    of the ranges before it; no task sees a whole label.
    """
    h = F.md5(F.concat(text(key), F.lit(f":{seed}")))
    x = df.withColumns({"_h": h, "_r": F.substring(h, 1, 4)})
    w = Window.partitionBy(label, "_r").orderBy("_h", key)
    x = x.withColumn("_i", F.row_number().over(w))
    per = df.select(label, F.substring(h, 1, 4).alias("_r")).groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_c"))
    prior = Window.partitionBy(label).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(label).alias("_l"), F.col("_r").alias("_r2"), F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_off"))
    x = x.join(per, x[label].eqNullSafe(per["_l"]) & (x["_r"] == per["_r2"]), "left")
    return x.withColumn(out, F.pmod(F.col("_off") + F.col("_i") - 1, F.lit(k)).cast("int")).drop("_h", "_r", "_i", "_l", "_r2", "_off")


def group_folds(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """Whole groups per fold, balanced: the next largest group joins the lightest fold.

    Groups are numbered from the largest to the smallest, equal sizes in key order.
    Only the distinct sizes are balanced one by one: groups of one size are dealt in
    turns, and a turn is written down with the range of numbers it serves.
    """
    sizes = df.where(c(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias(SIZE))
    order = sizes.select((-F.col(SIZE)).alias("_rank"), text(group).alias("_text"), group, SIZE)
    numbered = cut(dense_codes(order, ["_rank", "_text"], "_no").select(group, SIZE, "_no"))
    classes = numbered.groupBy(SIZE).agg(F.count(F.lit(1)).alias("m"), F.min("_no").alias("first")).collect()
    turns = _deal([(r[SIZE], r["m"], r["first"]) for r in classes], k)
    table = df.sparkSession.createDataFrame(turns, "_n long, _from long, _to long, _cycle array<int>")
    same = (F.col(SIZE) == F.col("_n")) & (F.col("_no") >= F.col("_from")) & (F.col("_no") < F.col("_to"))
    # A few rows per distinct size.
    dealt = numbered.join(F.broadcast(table) if len(turns) <= FEW else table, same)
    fold = F.get("_cycle", F.pmod(F.col("_no") - F.col("_from"), F.size("_cycle")).cast("int"))
    return attach(df, dealt.select(group, SIZE, fold.alias(out)), [group])


def _deal(classes: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first number, number after the last, folds in turn) for classes of (size, groups, first number)."""
    load, out = [0] * k, []
    for n, m, first in sorted(classes, reverse=True):
        at, end = first, first + m
        while at < end:
            turn = sorted(range(k), key=lambda f: (load[f], f))
            # The folds that take their turns before any other is as light as they are.
            lead = [f for f in turn if load[f] < load[turn[0]] + n]
            rest = [load[f] for f in turn if f not in lead]
            room = (min(rest) - max(load[f] for f in lead)) // n if rest else (end - at) // len(lead)
            rounds = min(max(0, room), (end - at) // len(lead))
            if rounds:
                out.append((n, at, at + rounds * len(lead), lead))
                at += rounds * len(lead)
                for f in lead:
                    load[f] += rounds * n
            else:
                out.append((n, at, at + 1, [turn[0]]))
                load[turn[0]] += n
                at += 1
    return out


def month_fold(ts: str | Column, merge: dict[str, str] | None = None) -> Column:
    """``2018-5`` style month name, with months folded into others on request."""
    from ..functions.safe import month_label

    m = month_label(ts)
    for a, b in (merge or {}).items():
        m = F.when(m == a, F.lit(b)).otherwise(m)
    return m


def merged_folds(parts: Sequence[DataFrame], key: str, k: int, seed: int = 0) -> DataFrame:
    """Each set is folded by itself, then fold i of all sets is one fold."""
    out = [folds(p, key, k, seed).withColumn("set_no", F.lit(i)) for i, p in enumerate(parts)]
    x = out[0]
    for p in out[1:]:
        x = x.unionByName(p)
    return x


def time_holdout(df: DataFrame, seconds: str, share: float = 0.8, out: str = "part") -> DataFrame:
    """First ``share`` of the time axis by quantile is ``train``, the rest ``valid``."""
    border = exact_quantiles(df, seconds, [share]).select("quantile").scalar()
    return df.withColumn("_c", border).withColumn(out, F.when(c(seconds) <= F.col("_c"), "train").otherwise("valid")).drop("_c")
