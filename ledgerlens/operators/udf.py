"""Ways in for user functions when no built-in expression will do."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut


def map_arguments(spark: SparkSession, func: Callable, args: DataFrame, schema: str) -> DataFrame:
    """Call ``func(**row)`` for each row of an argument table and return its dict as a row."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            yield pd.DataFrame([func(**r) for r in b.to_dict("records")])

    return args.mapInPandas(run, schema)


def map_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply a frame function to Arrow batches of rows."""

    def run(batches):
        for b in batches:
            yield func(b)

    return df.mapInPandas(run, schema)


def map_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], func: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Apply an elementwise series function to each column, batch by batch."""
    f = F.pandas_udf(func, "double")
    return df.select(*keys, *[f(F.col(x).cast("double")).alias(x) for x in cols])


# Rows of one key that go to a task together.
SLICE_ROWS = 100_000


def grouped_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    lift: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: str,
    schema: str,
    fan_in: int = 64,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Custom group aggregate with a combiner, so that no task holds a whole group.

    Rows are dealt out and sorted by key first, those of keys with more than
    ``slice_rows`` rows in slices, so that a key is lifted about once a slice.
    ``lift`` turns the rows of one key within a batch into a few partial rows,
    ``merge`` combines partial rows of one key into fewer (one, in the end), ``finish``
    turns the last partials into the result. All of them get and return the key
    columns. The partials of a key are numbered and merged ``fan_in`` at a time, round
    by round, until no key has more than that many; each round is checkpointed.
    """
    keys = list(keys)

    def combine(batches):
        for b in batches:
            parts = [lift(g) for _, g in b.groupby(keys, sort=False, dropna=False)]
            if parts:
                yield pd.concat(parts)

    parts, before = cut(_by_key(df, keys, slice_rows).mapInPandas(combine, partial_schema)), None
    while True:
        most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= fan_in or most == before:
            return parts.groupBy(*keys).applyInPandas(lambda g: finish(merge(g)), schema)
        numbered = _numbered(parts, keys).withColumn("_turn", F.floor(F.col("_no") / fan_in)).drop("_no")
        parts = cut(numbered.groupBy(*keys, "_turn").applyInPandas(lambda g: merge(g.drop(columns="_turn")), partial_schema))
        before = most


def _by_key(df: DataFrame, keys: Sequence[str], slice_rows: int) -> DataFrame:
    """The rows with those of a key side by side; only keys of many rows are counted out to every task, one row each."""
    names = [f"_k{i}" for i in range(len(keys))]
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    large = large.select(*[c(k).alias(n) for k, n in zip(keys, names)], F.ceil(F.col("_n") / slice_rows).alias("_slices"))
    same = reduce(and_, [c(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    row = df.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(large), same, "left")
    row = row.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.coalesce("_slices", F.lit(1))))
    return row.repartition(*keys, "_slice").sortWithinPartitions(*keys).select(*df.columns)


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_no`` from 0 up within each key: the place among the key's rows of a partition, behind those of the partitions before."""
    keys = list(keys)
    rows = df.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_i")) - 1)
    per = df.groupBy(*keys, F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_part"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(per, same).select(*df.columns, (F.col("_in") + F.col("_before")).alias("_no"))


def row_function(func: Callable[..., pd.Series], returns: str):
    """Vectorised function over several columns."""
    return F.pandas_udf(func, returns)
