"""Category codes, one-hot forms, discretisers and scalers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import bounded_values, c, ratio
from .aggs import mode_fill, sentinel_count
from .attach import FEW, SIZE, attach, group_size
from .ordering import dense_codes, quantile_list


def code_table(df: DataFrame, col: str, out: str, few: bool = False) -> DataFrame:
    """Sorted distinct values with consecutive codes from 0; ``few`` for a short list of values."""
    if few:
        values = bounded_values(df, col, FEW)
        schema = T.StructType([df.schema[col], T.StructField(out, T.LongType())])
        return F.broadcast(df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], schema))
    return dense_codes(df.where(c(col).isNotNull()).groupBy(col).agg(group_size()), [col], out)


def label_encode(df: DataFrame, cols: Sequence[str], drop: bool = True, few: bool = False) -> DataFrame:
    """``label__col``: position in sort order over all rows given (both splits)."""
    for x in cols:
        df = attach(df, code_table(df, x, f"label__{x}", few), [x])
        df = df.drop(x) if drop else df
    return df


def factorize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace values by sorted codes; missing values become -1."""
    for x in cols:
        coded = attach(df, code_table(df, x, "_code"), [x])
        df = coded.withColumn(x, F.coalesce(F.col("_code"), F.lit(-1).cast("long"))).drop("_code")
    return df


def one_hot_long(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(id, slot) for every value of every column, slots in order of column and value; any number of values."""
    long = df.select(id_col, *[c(x).cast("string").alias(x) for x in cols]).unpivot([id_col], list(cols), "feature", "level")
    long = long.where("level IS NOT NULL")
    slots = dense_codes(long.groupBy("feature", "level").agg(group_size()), ["feature", "level"], "slot")
    return attach(long, slots, ["feature", "level"]).select(id_col, "slot")


def one_hot(
    df: DataFrame, cols: Sequence[str], drop: bool = True, limit: int = 1000, levels: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """0/1 columns ``col_value_dummie`` for the given ``levels`` or all values of a column.

    A wide table needs a bound on its columns: more than ``limit`` values are an
    error, and ``one_hot_long`` is the form for them.
    """
    for x in cols:
        values = list(levels[x]) if levels and x in levels else bounded_values(df, x, limit)
        df = df.withColumns(
            {f"{x}_{v}_dummie": F.coalesce((c(x) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
        )
        df = df.drop(x) if drop else df
    return df


def encode_by_cardinality(df: DataFrame, cols: Sequence[str], high: int = 15, low: int = 2) -> DataFrame:
    """Many values: count and code. A few: also one-hot. Two or fewer: code only.

    The distinct counts of all columns come from one aggregate.
    """
    filled = df.withColumns({x: F.coalesce(c(x).cast("string"), F.lit("#")) for x in cols})
    row = df.agg(*[F.count_distinct(x).alias(x) for x in cols]).first()
    out = filled
    for x in cols:
        n = row[x]
        if n > low:
            out = sentinel_count(out, x, drop=False, few=n <= FEW)
        out = label_encode(out, [x], drop=False, few=n <= FEW)
        if low < n <= high:
            out = one_hot(out, [x], drop=False)
        out = out.drop(x)
    return out


def sparse_levels(
    df: DataFrame, id_col: str, split: str, cols: Sequence[str], min_train: int = 20, low: float = 0.05, high: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """Long one-hot form restricted to levels common in train and present in both splits.

    Returns the level table (feature, level, counts, slot) and the (id, slot) rows.
    """
    long = df.select(id_col, split, *[c(x).cast("string").alias(x) for x in cols]).unpivot(
        [id_col, split], list(cols), "feature", "level"
    )
    long = long.withColumn("level", F.coalesce("level", F.lit("nan")))
    train = F.sum((c(split) == "train").cast("int"))
    level = long.groupBy("feature", "level").agg(train.alias("n_train"), F.count(F.lit(1)).alias("n_total"))
    share = F.col("n_train") / F.col("n_total")
    level = level.where((F.col("n_train") > min_train) & (share > low) & (share < high))
    level = dense_codes(level, ["feature", "level"], "slot")
    slots = level.select("feature", "level", "slot", F.col("n_total").alias(SIZE))
    rows = attach(long, slots, ["feature", "level"]).where("slot IS NOT NULL")
    return level, rows.select(id_col, "slot")


def quantile_bins(df: DataFrame, col: str, q: int = 100, out: str | None = None, fill: float | None = None) -> DataFrame:
    """Equal-frequency bins ``(a, b]`` on exact quantiles; equal edges merge into one."""
    out = out or f"bin__{col}"
    src = df.withColumn("_binned", c(col).cast("double") if fill is None else F.coalesce(c(col).cast("double"), F.lit(float(fill))))
    edges = sorted(set(quantile_list(src, "_binned", [i / q for i in range(q + 1)])))
    return _bucketed(src, edges, out).drop("_binned")


def _bucketed(src: DataFrame, edges: Sequence[float], out: str) -> DataFrame:
    # Bucketizer is closed on the left, so bin the mirrored value and mirror the number back.
    inner = [-e for e in reversed(edges[1:-1])]
    splits = [-float("inf"), *inner, float("inf")]
    src = src.withColumn("_cut_in", -F.col("_binned"))
    if len(splits) == 2:
        return src.withColumn(out, F.when(F.col("_binned").isNotNull(), F.lit(0))).drop("_cut_in")
    b = Bucketizer(splits=splits, inputCol="_cut_in", outputCol="_cut_out", handleInvalid="keep").transform(src)
    code = F.lit(len(inner)) - F.col("_cut_out").cast("int")
    return b.withColumn(out, F.when(F.col("_binned").isNotNull(), code)).drop("_cut_in", "_cut_out")


def equal_frequency_digits(df: DataFrame, col: str, q: int = 50, out: str | None = None) -> DataFrame:
    """Mode-filled value digitised on ``q`` equal-frequency edges: the number of edges at or below it."""
    out = out or f"digit__{col}"
    src = mode_fill(df.withColumn("_binned", c(col).cast("double")), "_binned")
    edges = sorted(set(quantile_list(src, "_binned", [i / q for i in range(q)])))
    splits = [-float("inf"), *edges, float("inf")]
    b = Bucketizer(splits=splits, inputCol="_binned", outputCol="_cut_out", handleInvalid="keep").transform(src)
    return b.withColumn(out, F.col("_cut_out").cast("int")).drop("_binned", "_cut_out")


def scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min-max and standard scaling over all rows given (population deviation)."""
    aggs = []
    for x in cols:
        aggs += [F.min(x).alias(f"{x}_lo"), F.max(x).alias(f"{x}_hi"), F.avg(x).alias(f"{x}_m"), F.stddev_pop(x).alias(f"{x}_s")]
    s = "_s"
    out = df.withColumn(s, df.agg(F.struct(*aggs).alias("s")).scalar())
    for x in cols:
        lo, hi = F.col(f"{s}.{x}_lo"), F.col(f"{s}.{x}_hi")
        out = out.withColumns(
            {
                f"{x}_minmax": ratio(c(x) - lo, hi - lo),
                f"{x}_standard": ratio(c(x) - F.col(f"{s}.{x}_m"), F.col(f"{s}.{x}_s")),
            }
        )
    return out.drop(s)
