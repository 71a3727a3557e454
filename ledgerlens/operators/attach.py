"""Join per-key tables back to rows, also when one key holds a third of them.

A shuffle join sends all rows of a key to one task, and adaptive execution
cannot split it when the other side is an aggregate. A per-key table that knows
its group sizes (column ``_size``) therefore is used twice: the HOT_KEYS
largest keys are broadcast, so that no other key holds more than 1/HOT_KEYS of
the rows; every other row meets its key in a shuffle join. Rows already served
by the broadcast, and rows without a key, carry a salt there, so they spread
over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, has_all

SIZE = "_size"
HOT_KEYS = 2000
SALTS = 1024
FEW = 100_000


def group_size() -> Column:
    """The aggregate that makes a per-key table skew-proof."""
    return F.count(F.lit(1)).alias(SIZE)


def attach(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], few: bool = False, null_safe: bool = False, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left join of a table that holds each key once; the rows of ``df`` stay as they are.

    ``few`` is for keys with a short list of values (products, months): the
    table is fetched once and broadcast, unless it has more than FEW rows.
    ``null_safe`` lets a missing key match a missing key.
    """
    keys = list(keys)
    names = [x for x in stats.columns if x not in keys and x != SIZE]
    if few:
        rows = stats.select(*keys, *names).limit(FEW + 1).collect()
        if len(rows) <= FEW:
            small = df.sparkSession.createDataFrame(rows, stats.select(*keys, *names).schema)
            return _left(df, F.broadcast(_renamed(small, keys)), keys, null_safe).select(*df.columns, *names)
    if SIZE not in stats.columns:
        return _left(df, _renamed(stats, keys), keys, null_safe).select(*df.columns, *names)
    packed = _renamed(stats, keys)
    key_cols = [f"_key{i}" for i in range(len(keys))]
    packed = packed.select(*key_cols, SIZE, F.struct(*names).alias("_cold"))
    hot = packed.orderBy(F.desc(SIZE)).limit(hot_keys).select(*key_cols, F.col("_cold").alias("_hot"))
    x = _left(df, F.broadcast(hot), keys, null_safe).select(*df.columns, "_hot")
    done = F.col("_hot").isNotNull() if null_safe else F.col("_hot").isNotNull() | ~has_all(keys)
    x = x.withColumn("_salt", F.when(done, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)) + 1).otherwise(F.lit(0)))
    # reading the size here too, and first, lets Spark run one exchange for both uses of the table
    cold = packed.select(*key_cols, F.when(F.col(SIZE) > 0, F.lit(0).cast("long")).alias("_salt0"), "_cold")
    x = _left(x, cold, keys, null_safe, F.col("_salt") == F.col("_salt0"))
    found = F.coalesce("_hot", "_cold")
    return x.select(*df.columns, *[found[n].alias(n) for n in names])


def _renamed(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})


def _left(df: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool, *extra: Column) -> DataFrame:
    same = [c(k).eqNullSafe(F.col(f"_key{i}")) if null_safe else c(k) == F.col(f"_key{i}") for i, k in enumerate(keys)]
    return df.join(right, reduce(and_, [*same, *extra]), "left")
