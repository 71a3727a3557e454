"""Column selection and row-wise arithmetic."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations, product
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .safe import c, ratio


# -- selection ---------------------------------------------------------------

def categorical_columns(df: DataFrame, ignore: Iterable[str] = ()) -> list[str]:
    ignore = set(ignore)
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in ignore]


def datetime_columns(df: DataFrame, ignore: Iterable[str] = ()) -> list[str]:
    ignore = set(ignore)
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in ignore]


def numeric_columns(df: DataFrame, ignore: Iterable[str] = ()) -> list[str]:
    ignore = set(ignore)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in ignore]


def columns_like(
    df: DataFrame, prefix: str | None = None, contains: str | None = None, pattern: str | None = None
) -> list[str]:
    return [
        n
        for n in df.columns
        if (prefix is None or n.startswith(prefix))
        and (contains is None or contains in n)
        and (pattern is None or re.search(pattern, n))
    ]


def rename_replace(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnsRenamed({n: n.replace(old, new) for n in df.columns if old in n})


# -- arithmetic between columns -----------------------------------------------

def pair_ratios(cols: Sequence[str], k: float = 1, pairs: Iterable[tuple[str, str]] | None = None) -> list[Column]:
    """``a/(b+k)`` for every pair of ``cols`` (or the given pairs)."""
    use = list(pairs) if pairs is not None else list(combinations(cols, 2))
    return [ratio(a, b, k).alias(f"{a}_div_{b}") for a, b in use]


def cross_ratios(left: Sequence[str], right: Sequence[str], k: float = 1) -> list[Column]:
    return [ratio(a, b, k).alias(f"{a}_per_{b}") for a, b in product(left, right)]


def difference(a: str, b: str) -> Column:
    return (c(a) - c(b)).alias(f"{a}_minus_{b}")


def distance(a: str, b: str) -> Column:
    return F.abs(c(a) - c(b)).alias(f"{a}_dist_{b}")


def same_flag(a: str | Column, b: str | Column) -> Column:
    """1 where both are equal, 0 otherwise, also when one is missing."""
    return F.coalesce((c(a) == c(b)).cast("int"), F.lit(0))


def _present(cols: Sequence[str]) -> Column:
    return reduce(add, [c(x).isNotNull().cast("int") for x in cols])


def block_stats(cols: Sequence[str], name: str) -> list[Column]:
    """Mean, sum, sample std, max and product of a column block; nulls are skipped.

    Written as plain arithmetic so that it stays inside generated code.
    """
    n = _present(cols)
    total = reduce(add, [F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols])
    mean = F.try_divide(total, n)
    dev = reduce(add, [F.coalesce(F.pow(c(x) - mean, 2), F.lit(0.0)) for x in cols])
    prod = reduce(lambda a, b: a * b, [F.coalesce(c(x).cast("double"), F.lit(1.0)) for x in cols])
    top = F.greatest(*[c(x).cast("double") for x in cols]) if len(cols) > 1 else c(cols[0]).cast("double")
    return [
        mean.alias(f"{name}_mean"),
        total.alias(f"{name}_sum"),
        F.when(n > 1, F.sqrt(F.try_divide(dev, n - 1))).alias(f"{name}_std"),
        top.alias(f"{name}_max"),
        prod.alias(f"{name}_pro"),
    ]


def null_count(cols: Sequence[str]) -> Column:
    return reduce(add, [c(x).isNull().cast("int") for x in cols])


def flag_sum(conds: Sequence[Column]) -> Column:
    return reduce(add, [F.coalesce(x.cast("int"), F.lit(0)) for x in conds])


def product_plus_one(cols: Sequence[str]) -> Column:
    """``prod(x + 1)`` over score columns; a missing score counts as zero."""
    return reduce(lambda a, b: a * b, [F.coalesce(c(x).cast("double"), F.lit(0.0)) + 1 for x in cols])


def split_by_category(value: str, category: str, levels: Sequence, default=None) -> list[Column]:
    """One column per level holding ``value`` there and ``default`` elsewhere."""
    other = F.lit(default).cast("double")
    return [
        F.when(c(category) == F.lit(lv), c(value).cast("double")).otherwise(other).alias(f"{value}__{category}-{lv}")
        for lv in levels
    ]


# -- rules --------------------------------------------------------------------

def decision_list(rules: Sequence[tuple], default) -> Column:
    """First matching rule wins. A rule is ``(label, (column, text), ...)`` and
    matches when every text occurs in its column."""
    out = F
    for label, *tests in rules:
        cond = reduce(and_, [c(col).contains(token) for col, token in tests])
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def ladder(value: str | Column, steps: Sequence[tuple[float, object]], below) -> Column:
    """Largest step reached: ``steps`` are (lower bound, label) from high to low."""
    v = c(value)
    out = None
    for bound, label in steps:
        out = F.when(v >= bound, F.lit(label)) if out is None else out.when(v >= bound, F.lit(label))
    return out.otherwise(F.lit(below))


def recode(value: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup as a literal map; unknown values become ``default``."""
    flat = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*flat), c(value))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def clip(value: str | Column, low=None, high=None) -> Column:
    """Bounds may be numbers or columns; a missing value stays missing."""
    v = c(value)
    out = v
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(v.isNotNull(), out)
