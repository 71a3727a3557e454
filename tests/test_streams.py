"""Streamed trailing counts against the batch windows, file by file, with late and odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import streams, windows
from ledgerlens.session import scratch

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "k string, ts timestamp"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def at(day, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour)


def number(day):
    return (at(day) - dt.datetime(1970, 1, 1)).days


@pytest.fixture(scope="module")
def rows():
    return [("ab"[i % 7 == 0], at(i // 5 + 9 * (i > 60), i % 5)) for i in range(100)]


def test_a_table_gives_the_batch_windows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1.0))
    got = streams.trailing_counts(df, ["k"], "ts", [1, 3, 7])
    want = windows.window_days(df, ["k"], "ts", "v", [1, 3, 7], ["count"]).select("k", "_day", *[f"day{n}_v_count" for n in (1, 3, 7)])
    assert answer(got) == answer(want)


def test_files_in_time_order_give_the_closed_days(spark, rows):
    path = scratch(spark, "stream-files")
    for start in range(0, 100, 20):
        write(spark, rows[start : start + 20], path)
    every = answer(streams.trailing_counts(spark.read.parquet(path), ["k"], "ts", [1, 3]))
    got = streams.drain(streams.trailing_counts(read(spark, path), ["k"], "ts", [1, 3], late="2 days"))
    newest = max(ts for _, ts in rows)
    closed = [r for r in every if DAY + dt.timedelta(days=r[1] - number(0) + 1) <= newest - dt.timedelta(days=2)]
    assert answer(got) == closed and 0 < len(closed) < len(every)


def test_a_row_behind_the_watermark_is_left_out(spark):
    path = scratch(spark, "stream-late")
    write(spark, [("a", at(0)), ("a", at(1))], path)
    write(spark, [("a", at(10))], path)
    write(spark, [("a", at(10, 2))], path)
    # A day late counts, nine days late does not.
    write(spark, [("a", at(9, 5)), ("a", at(1, 3))], path)
    write(spark, [("a", at(20))], path)
    got = streams.drain(streams.trailing_counts(read(spark, path), ["k"], "ts", [1, 9], late="1 day"))
    assert answer(got) == [("a", number(0), 1, 1), ("a", number(1), 2, 2), ("a", number(9), 1, 3), ("a", number(10), 3, 4)]


def test_hours_and_rows_without_key_or_time(spark):
    path = scratch(spark, "stream-hours")
    write(spark, [("a", at(0, 1)), ("a", at(0, 1)), (None, at(0, 1)), ("a", None), ("a", at(0, 3)), ("a", at(1))], path)
    got = streams.drain(streams.trailing_counts(read(spark, path), ["k"], "ts", [0, 1, 2], "hour", "1 hour"))
    first = number(0) * 24
    assert answer(got) == [("a", first + 1, 2, 2, 2), ("a", first + 3, 1, 1, 3)]


def test_an_empty_table_and_no_keys(spark):
    path = scratch(spark, "stream-empty")
    write(spark, [], path)
    assert answer(streams.drain(streams.trailing_counts(read(spark, path), ["k"], "ts", [1]))) == []
    df = spark.createDataFrame([("a", at(0)), (None, at(0)), ("b", at(1))], SCHEMA)
    assert answer(streams.trailing_counts(df, [], "ts", [1])) == [(number(0), 2), (number(1), 3)]


def test_totals_are_made_before_they_are_copied_into_windows(spark, rows):
    df = streams.trailing_counts(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", [31])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")
