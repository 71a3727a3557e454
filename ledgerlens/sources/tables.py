"""The input tables and the transaction views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import month_index
from ..operators.attach import attach, group_size
from ..session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Orders from this day on are the unlabelled (test) rows.
TEST_FROM = "2000-04-11"


class Tables:
    """Lazy access to the Parquet tables of one folder: ``t.orders``, ``t.txn`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def stream(self, name: str, **options: str) -> DataFrame:
        """A table as a stream of its files; ``options`` go to the file source (``maxFilesPerTrigger``, say)."""
        # A pattern that only the table's name fits: the source takes a plain path for a folder, and a table can be one file.
        path = f"{self.folder}/{name}.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).options(**options).parquet(f"{self.folder}/{name}.[p]arquet")

    @property
    def txn(self) -> DataFrame:
        """Transactions: one row per order with split and label (NULL in test)."""
        o = self.orders
        test = F.col("o_orderdate") >= F.lit(TEST_FROM).cast("timestamp_ntz")
        return o.select(
            F.col("o_orderkey").alias("txn_id"),
            F.col("o_custkey").alias("uid"),
            F.col("o_totalprice").alias("amt"),
            F.col("o_orderpriority").alias("product"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("ts"),
            month_index("o_orderdate").alias("month"),
            F.when(test, "test").otherwise("train").alias("split"),
            F.when(~test, (F.col("o_orderstatus") == "F").cast("int")).alias("label"),
        )

    @property
    def txn_wide(self) -> DataFrame:
        """Transactions with the customer's segment and nation."""
        cust = self.customer.select(
            F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
        )
        return self.txn.join(cust, "uid", "left")

    @property
    def txn_aged(self) -> DataFrame:
        """Transactions with ``d1``, the days since the customer's first order."""
        t = self.txn
        first = t.groupBy("uid").agg(F.min("ts").alias("_first"), group_size())
        return attach(t, first, ["uid"]).withColumn("d1", F.datediff("ts", "_first")).drop("_first")

    @property
    def ev(self) -> DataFrame:
        """Events with the number of the JSON property and a rare-positive label."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            "event_id", "ts", "user_id", "event_type", "value", k.alias("k"), (k >= 90).cast("int").alias("label")
        )


# The same views for the comparison SQL.
TXN_SQL = f"""txn AS (
  SELECT o_orderkey AS txn_id, o_custkey AS uid, o_totalprice AS amt, o_orderpriority AS product,
         o_orderstatus AS status, o_orderdate AS ts, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month,
         CASE WHEN o_orderdate >= TIMESTAMP '{TEST_FROM}' THEN 'test' ELSE 'train' END AS split,
         CASE WHEN o_orderdate < TIMESTAMP '{TEST_FROM}' THEN CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS label
  FROM orders)"""

TXN_WIDE_SQL = f"""{TXN_SQL}, txn_wide AS (
  SELECT txn.*, c_mktsegment AS segment, c_nationkey AS nation FROM txn LEFT JOIN customer ON uid = c_custkey)"""

TXN_AGED_SQL = f"""{TXN_SQL}, txn_aged AS (
  SELECT txn.*, date_diff('day', (min(ts) OVER (PARTITION BY uid))::DATE, ts::DATE) AS d1 FROM txn)"""

EV_SQL = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 90 THEN 1 ELSE 0 END AS label FROM events)"""
