"""Files: scans, snapshots, keyed feature tables, and the feature catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import c
from ..operators.attach import attach


def read_csv(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if limit is None else df.limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back; later work starts from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_shards(df: DataFrame, path: str, n: int) -> None:
    """``n`` files, or as many as the table is read in if that is more, so that no task writes more than a scan's."""
    df.repartition(max(n, df.rdd.getNumPartitions())).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, pattern: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(pattern)
    return df.select(*cols) if cols else df


def write_column(df: DataFrame, key: str, col: str, split: str, path: str, fmt: str = "parquet") -> None:
    """One feature column of one split under ``<name>_<split>``."""
    out = df.where(F.col("split") == split).select(key, F.col(col).alias("value"))
    w = out.write.mode("overwrite").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(f"{path}/{col}_{split}")


def load_column(spark: SparkSession, path: str, key: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """(key, feature, value): the feature name comes from the folder, without its split suffix."""
    r = spark.read.format(fmt)
    if schema:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return df.select(key, F.regexp_replace(folder, "_(train|test)$", "").alias("feature"), "value")


def assemble_columns(spine: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join keyed feature tables onto the spine; tables with group sizes are joined skew-proof."""
    return reduce(lambda a, b: attach(a, b, [key]), tables, spine)


def save_features(df: DataFrame, key: str, prefix: str, path: str, cols: Sequence[str], as_float: bool = True) -> None:
    """Keyed feature table partitioned by split; an existing table is left alone."""
    out = [F.col(x).cast("float") if as_float else F.col(x) for x in cols]
    named = [x.alias(f"{prefix}__{n}") for x, n in zip(out, cols)]
    df.select(key, "split", *named).write.mode("ignore").partitionBy("split").parquet(path)


def oof_features(tables: dict[str, DataFrame], key: str, pred: str) -> DataFrame:
    """Prediction tables side by side as ``oof_<name>``; a row in any table stays."""
    parts = [d.select(key, c(pred).alias(f"oof_{n}")) for n, d in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "outer"), parts)


def write_predictions(df: DataFrame, key: str, pred: str, label: str, path: str) -> None:
    """``id,label`` CSV in key order."""
    df.select(key, c(pred).alias(label)).orderBy(key).write.mode("overwrite").option("header", True).csv(path)


# -- catalog: (feature, split, stage) ------------------------------------------------------


def find_features(catalog: DataFrame, fragments: Sequence[str], file_key: str = "") -> DataFrame:
    """Features that contain a fragment, share its first three letters, and contain ``file_key``."""
    tests = [
        F.col("feature").contains(f) & (F.substring("feature", 1, 3) == f[:3]) & F.col("feature").contains(file_key)
        for f in fragments
    ]
    return catalog.where(reduce(lambda a, b: a | b, tests))


def unpaired(catalog: DataFrame) -> DataFrame:
    """Features present in one split only."""
    side = lambda s: catalog.where(F.col("split") == s).select("feature", F.lit(1).alias(f"in_{s}")).distinct()
    j = side("train").join(side("test"), "feature", "outer").na.fill(0)
    return j.where("in_train + in_test < 2")


def move_features(catalog: DataFrame, features: DataFrame, source: str, target: str) -> DataFrame:
    """Catalog with the listed features promoted from one stage to another."""
    hit = features.select("feature", F.lit(True).alias("_hit")).distinct()
    j = catalog.join(hit, "feature", "left")
    moved = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("stage") == source)
    return j.withColumn("stage", F.when(moved, F.lit(target)).otherwise(F.col("stage"))).drop("_hit")
