"""Managed tables: definitions, loads, deletes and the experiment log."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import c
from ..session import discard


def warehouse_type(t: T.DataType) -> str:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(t, (T.IntegralType, T.DecimalType)):
        return "NUMERIC"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    return "STRING"


def inferred_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, warehouse_type(f.dataType)) for f in df.schema]


SPARK_TYPES = {"FLOAT": "DOUBLE", "NUMERIC": "DECIMAL(38,9)", "DATE": "DATE", "STRING": "STRING"}


class Warehouse:
    """One database whose tables live below ``location``."""

    def __init__(self, spark: SparkSession, name: str, location: str):
        self.spark, self.name, self.location = spark, name, location.rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{self.location}'")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")

    def create(self, table: str, columns: Sequence[tuple[str, str, bool]]) -> None:
        """Columns are (name, warehouse type, required)."""
        cols = ", ".join(f"`{n}` {SPARK_TYPES[t]}{' NOT NULL' if req else ''}" for n, t, req in columns)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}.{table} ({cols}) USING parquet")

    def add_column(self, table: str, name: str, kind: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name}.{table} ADD COLUMNS (`{name}` {SPARK_TYPES[kind]})")

    def tables(self, prefix: str = "") -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.name) if t.name.startswith(prefix))

    def drop_tables(self, prefix: str) -> list[str]:
        gone = self.tables(prefix)
        for t in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{t}")
        return gone

    def load_csv(self, table: str, path: str, schema: str) -> None:
        df = self.spark.read.schema(schema).option("header", True).csv(path)
        df.write.mode("append").format("parquet").saveAsTable(f"{self.name}.{table}")

    def insert(self, table: str, rows: DataFrame) -> None:
        """Rows aligned to the table's columns by name; missing ones are NULL."""
        self._aligned(table, rows).write.mode("append").insertInto(f"{self.name}.{table}")

    def _aligned(self, table: str, rows: DataFrame) -> DataFrame:
        target = self.table(table)
        have = set(rows.columns)
        return rows.select(
            *[
                (c(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in target.schema
            ]
        )

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{table}")

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def create_as(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").format("parquet").saveAsTable(f"{self.name}.{table}")

    def place(self, table: str) -> str:
        """The folder that holds the table's current version."""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}.{table}").where("col_name = 'Location'")
        return rows.first()["data_type"]

    def replace(self, table: str, df: DataFrame) -> None:
        """The table's rows become ``df``, which may read the table.

        The new version is written once, to a folder of its own. Until it is complete
        the table shows the old files; then its location changes in one step of the
        catalog, and the old files go. Whatever fails before leaves the table as it was.
        """
        old, new = self.place(table), f"{self.location}/{table}__{uuid.uuid4().hex}"
        try:
            df.write.parquet(new)
            self._switch(table, new)
        except BaseException:
            discard(self.spark, new)
            raise
        discard(self.spark, old)

    def _switch(self, table: str, path: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name}.{table} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(f"{self.name}.{table}")

    def delete(self, table: str, col: str, values: Sequence | DataFrame) -> None:
        """Rows whose ``col`` is in the list, or in the first column of a table, go."""
        self.replace(table, without_values(self.table(table), col, values))


def without_values(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """``DELETE ... WHERE col IN (...)`` as an anti join with the list; rows with a missing value stay."""
    kind = df.select(c(col)).schema[0].dataType
    if not isinstance(values, DataFrame):
        values = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("_listed", kind)]))
    listed = values.select(values[values.columns[0]].cast(kind).alias("_listed")).distinct()
    return df.join(listed, c(col) == F.col("_listed"), "left_anti")


# The columns of the experiment log (name, type, required).
LOG_COLUMNS = [
    ("datetime", "STRING", True),
    ("n_features", "NUMERIC", True),
    ("n_rows", "NUMERIC", True),
    ("cv_score", "FLOAT", True),
    ("adv_cv_score", "FLOAT", False),
    ("fold1_score", "FLOAT", True),
    ("fold2_score", "FLOAT", True),
    ("fold3_score", "FLOAT", True),
    ("fold4_score", "FLOAT", True),
    ("fold5_score", "FLOAT", True),
    ("best_iteration", "NUMERIC", False),
    ("seed", "NUMERIC", True),
    ("metric", "STRING", True),
    ("model_type", "STRING", True),
    ("learning_rate", "FLOAT", True),
    ("objective", "STRING", True),
    ("num_leaves", "NUMERIC", False),
    ("max_depth", "NUMERIC", False),
    ("subsample", "FLOAT", False),
    ("subsample_freq", "FLOAT", False),
    ("colsample_bytree", "FLOAT", False),
    ("lambda_l1", "FLOAT", False),
    ("lambda_l2", "FLOAT", False),
    ("batch_size", "NUMERIC", False),
    ("n_epochs", "NUMERIC", False),
]


def log_rows(spark: SparkSession, results: Mapping, params: Mapping, columns=LOG_COLUMNS) -> DataFrame:
    """One log row; columns the results lack come from the parameters. A required column without a value is an error."""
    row = {n: results.get(n, params.get(n)) for n, _, _ in columns}
    missing = [n for n, _, required in columns if required and row[n] is None]
    if missing:
        raise ValueError(f"the log row lacks {', '.join(missing)}")
    kinds = {"FLOAT": T.DoubleType(), "NUMERIC": T.DoubleType(), "STRING": T.StringType(), "DATE": T.StringType()}
    as_kind = {"FLOAT": float, "NUMERIC": float, "STRING": str, "DATE": str}
    values = tuple(None if row[n] is None else as_kind[t](row[n]) for n, t, _ in columns)
    return spark.createDataFrame([values], T.StructType([T.StructField(n, kinds[t]) for n, t, _ in columns]))
