"""Line dedup by site-relative frequency.

A line's share is the number of a host's pages that contain it, divided by the
pages of the host. Lines above ``max_share`` on at least ``min_pages`` pages are
boilerplate and go. Pages of a host with identical text count as one page, so
that copies of an article do not turn its lines into boilerplate; a page that
has nothing but boilerplate lines is left as it is.

Lines are compared after trimming white space. Counting shuffles one hash per
distinct line of a page, combined before the shuffle; the boilerplate of a host
is at most (lines per page / max_share) hashes, so a host's list is short
whatever its number of pages, and a page meets the list of its host in one join.
Texts are never shuffled for the counts.

Cases: a missing text stays missing; a missing host is a host of its own; blank
lines are never counted nor dropped; repeated rows are treated alike, and lines
right at the ratio stay; texts of any length are cut whole, in arrays of their row; other
columns pass through whatever their names, one named like a result column is
replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pack, sized_broadcast, unpack

TRIM = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(TRIM)).cast("binary")))


def _keys(text: Column) -> Column:
    """Hashes of the distinct non-blank lines of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(TRIM)) != "")
    return F.array_distinct(F.transform(lines, _key))


def boilerplate(docs: DataFrame, host: str, text: str, max_share: float = 0.1, min_pages: int = 3) -> DataFrame:
    """One row per host that has boilerplate: ``_host``, ``_lines`` (hashes)."""
    pages = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(host).alias("_host"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_page"), _keys(F.col(text)).alias("_keys"))
        .groupBy("_host", "_page")
        .agg(F.first("_keys").alias("_keys"))
    )
    # One pass: a page adds 1 to each of its lines and 1 to the host's total (the line NULL).
    counts = (
        pages.select("_host", F.explode(F.concat(F.col("_keys"), F.array(F.lit(None).cast("binary")))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_line").isNull() | (F.col("_n") >= min_pages))
    )
    total = counts.where("_line IS NULL").select(F.col("_host").alias("_of"), F.col("_n").alias("_pages"))
    lines = counts.where("_line IS NOT NULL")
    return (
        lines.join(total, F.col("_host").eqNullSafe(F.col("_of")))
        .where(F.col("_n") > F.col("_pages") * F.lit(max_share))
        .groupBy("_host")
        .agg(F.collect_list("_line").alias("_lines"))
    )


def line_dedup(
    docs: DataFrame, host: str = "source", text: str = "text", max_share: float = 0.1, min_pages: int = 3
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text; adds ``n_lines`` and ``n_dropped``."""
    used = {"host": host, "text": text}
    df = pack(docs, **used)
    found = boilerplate(df, "_host", "_text", max_share, min_pages).withColumnRenamed("_host", "_of")
    found = sized_broadcast(found, 32 * F.size("_lines") + F.coalesce(F.octet_length("_of"), F.lit(0)))
    df = df.join(found, F.col("_host").eqNullSafe(F.col("_of")), "left")
    lines = F.split(F.col("_text"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_lines"), _key(x)))
    df = df.withColumn("_kept", F.when(F.col("_lines").isNotNull(), kept))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    change = F.col("_kept").isNotNull() & F.exists("_kept", lambda x: F.trim(x, F.lit(TRIM)) != "")
    dropped = F.when(change, n - F.size("_kept")).otherwise(0).cast("long")
    df = df.withColumns({"_n": n, "_dropped": dropped})
    df = df.withColumn("_text", F.when(F.col("_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("_text")))
    return unpack(df, docs.columns, used, {"n_lines": "_n", "n_dropped": "_dropped"})
