"""Null, zero and text-key rules shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TOKEN = "#"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column, k: float = 0) -> Column:
    """``a / (b + k)``; NULL instead of an error when the divisor is zero."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double") + F.lit(float(k)))


def no_nan(x: str | Column) -> Column:
    """NaN becomes NULL (NaN is a value in Spark, and the largest one)."""
    x = c(x)
    return F.when(~F.isnan(x), x)


def text(x: str | Column, null: str = NULL_TOKEN) -> Column:
    return F.coalesce(c(x).cast("string"), F.lit(null))


def composite_key(cols: Iterable[str | Column], sep: str = "_", null: str = NULL_TOKEN) -> Column:
    """``a_b_c`` with a visible token for NULL, which ``concat_ws`` would skip."""
    return F.concat_ws(sep, *[text(x, null) for x in cols])


def has_all(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for x in cols:
        out = out & F.col(x).isNotNull()
    return out


def epoch_seconds(ts: str | Column) -> Column:
    return c(ts).cast("timestamp").cast("long")


def epoch_micros(ts: str | Column) -> Column:
    return F.unix_micros(c(ts).cast("timestamp"))


def day_number(ts: str | Column) -> Column:
    return F.unix_date(c(ts).cast("date"))


def month_index(ts: str | Column) -> Column:
    return F.year(c(ts)) * 12 + F.month(c(ts)) - 1


def month_label(ts: str | Column) -> Column:
    """``2018-5``: year and unpadded month."""
    return F.concat_ws("-", F.year(c(ts)).cast("string"), F.month(c(ts)).cast("string"))


def bounded_values(df: DataFrame, col: str, limit: int = 1000) -> list:
    """Sorted distinct non-null values; an error when there are more than ``limit``."""
    rows = (
        df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)
