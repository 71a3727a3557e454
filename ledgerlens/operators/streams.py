"""Trailing counts over a stream of rows, with Structured Streaming.

A stream is added up twice: rows into totals of a slot (a day or an hour), and slots
into sliding windows that end with each of them. Only the totals are copied into
the windows, and a row is in one slot, so state is one row per key and slot that is
still open. A slot's answer is given once, when the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import has_all
from ..session import discard, scratch

SECONDS = {"day": 86400, "hour": 3600}


def trailing_counts(rows: DataFrame, keys: Sequence[str], ts: str, reach: Sequence[int], unit: str = "day", late: str = "1 day") -> DataFrame:
    """Per keys and slot with a row: ``_slot`` (number of the day or hour since 1970) and ``{unit}{n}_count`` for every n of ``reach``.

    A count takes the slot and the n slots before it, both ends included, as the batch
    windows do. ``rows`` is a stream; a slot appears when the newest row is ``late`` or more
    past its end, and rows of a slot that an earlier batch closed are left out. Rows
    without a key or time are left out, equal rows all count. A table that is no stream
    gives the same rows for all of its slots, an empty one gives none.
    """
    keys, seconds = list(keys), SECONDS[unit]
    slot = lambda end: (F.unix_seconds(end) / seconds).cast("int") - 1
    rows = rows.select(*keys, F.col(ts).cast("timestamp").alias("_ts"))
    if keys:
        rows = rows.where(has_all(keys))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", late)
    per = rows.groupBy(*keys, F.window("_ts", f"1 {unit}").alias("_one")).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_own", slot(F.col("_one.end")))
    span = F.window("_one", f"{max(reach) + 1} {unit}s", f"1 {unit}").alias("_span")
    per = per.select(*keys, span, "_own", "_n").withColumn("_slot", slot(F.col("_span.end")))
    counts = [F.sum(F.when(F.col("_own") >= F.col("_slot") - n, F.col("_n"))).alias(f"{unit}{n}_count") for n in reach]
    # A window whose last slot has no row is no answer.
    found = per.groupBy(*keys, "_span", "_slot").agg(F.max("_own").alias("_last"), *counts).where("_last = _slot")
    return found.select(*keys, "_slot", *[f"{unit}{n}_count" for n in reach])


def drain(stream: DataFrame, label: str = "stream") -> DataFrame:
    """What a stream gives for all that its source holds now.

    The rows and the stream's progress are written to the shared folder, so that a
    failed batch is written again as it was; the progress goes when the stream has ended.
    """
    spark: SparkSession = stream.sparkSession
    out, progress = scratch(spark, label), scratch(spark, f"{label}-progress")
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start(out)
    run.awaitTermination()
    discard(spark, progress)
    return spark.read.schema(stream.schema).parquet(out)
