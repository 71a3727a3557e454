"""Sources, sinks, the feature catalog and managed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggs as ag
from ..operators.attach import group_size
from ..session import scratch
from ..sources import store as st
from ..sources import warehouse as wh
from ..sources.tables import TXN_SQL, Tables
from .metric_queries import preds
from .registry import R, query, r, rs

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s01_csv_scan", "S01", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    path = scratch(t.spark, "customer-csv")
    st.write_csv(t.customer, path)
    return st.read_csv(t.spark, path, CUSTOMER_SCHEMA)


@query("s02_snapshot", "S02", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return st.snapshot(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), scratch(t.spark, "orders"))


@query("s03_sharded_table", "S03", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def _(t):
    path = scratch(t.spark, "lineitem-shards")
    st.write_shards(t.lineitem, path, 3)
    return st.read_shards(t.spark, f"{path}/part-*.parquet", ["l_orderkey", "l_linenumber", "l_tax"])


@query(
    "s04_single_column_load", "S04",
    f"""WITH {TXN_SQL} SELECT txn_id, 'amt' AS feature, amt AS value FROM txn
        UNION ALL SELECT txn_id, 'month', month::DOUBLE FROM txn""",
)
def _(t):
    path = scratch(t.spark, "columns")
    d = t.txn.withColumn("month", F.col("month").cast("double"))
    out = None
    for col, fmt in (("amt", "parquet"), ("month", "csv")):
        for split in ("train", "test"):
            st.write_column(d, "txn_id", col, split, path, fmt)
            x = st.load_column(t.spark, f"{path}/{col}_{split}", "txn_id", fmt, "txn_id bigint, value double")
            out = x if out is None else out.unionByName(x)
    return out


@query(
    "s05_assemble_columns", "S05",
    f"""WITH {TXN_SQL}, a AS (SELECT uid, avg(amt) AS m FROM txn GROUP BY 1), b AS (SELECT uid, count(*) AS n FROM txn WHERE status = 'F' GROUP BY 1)
      SELECT txn_id, {R('m')} AS uid_mean, coalesce(n, 0) AS uid_f FROM txn LEFT JOIN a USING (uid) LEFT JOIN b USING (uid)""",
)
def _(t):
    d = t.txn.select("txn_id", "uid", "amt", "status")
    m = ag.sized_stats(d, ["uid"], {"amt": ["mean"]}).withColumnRenamed("amt_mean", "uid_mean")
    n = d.groupBy("uid").agg(F.count_if(F.col("status") == "F").alias("uid_f"), group_size())
    x = st.assemble_columns(d.select("txn_id", "uid"), [m, n], "uid")
    return x.select("txn_id", r("uid_mean").alias("uid_mean"), F.coalesce("uid_f", F.lit(0)).alias("uid_f"))


# A catalog derived from the part table: feature name, split and stage.
CATALOG_SQL = """catalog AS (SELECT lower(p_type) || '__' || replace(p_brand, '#', '') || '_' || p_size AS feature,
  CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN p_retailprice > 950 THEN 'valid' ELSE 'org_use' END AS stage FROM part)"""


def catalog(t: Tables):
    name = F.concat_ws("_", F.concat(F.lower("p_type"), F.lit("__"), F.replace("p_brand", F.lit("#"), F.lit(""))), "p_size")
    return t.part.select(
        name.alias("feature"), F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("test").alias("split"),
        F.when(F.col("p_retailprice") > 950, "valid").otherwise("org_use").alias("stage"),
    )


@query(
    "s06_find_features", "S06",
    f"""WITH {CATALOG_SQL} SELECT feature, split, stage FROM catalog WHERE contains(feature, '_1')
        AND ((contains(feature, 'small__Brand1') AND feature LIKE 'sma%') OR (contains(feature, 'promo__') AND feature LIKE 'pro%'))""",
)
def _(t):
    return st.find_features(catalog(t), ["small__Brand1", "promo__"], "_1")


@query(
    "s07_feature_sink", "S07",
    f"""WITH {TXN_SQL} SELECT txn_id, split, amt::FLOAT::DOUBLE AS f__amt, month::FLOAT::DOUBLE AS f__month FROM txn""",
)
def _(t):
    path = scratch(t.spark, "features")
    st.save_features(t.txn, "txn_id", "f", path, ["amt", "month"])
    st.save_features(t.txn.where("amt < 0"), "txn_id", "f", path, ["amt", "month"])  # already there: left alone
    x = t.spark.read.parquet(path)
    return x.withColumns({n: F.col(n).cast("double") for n in ("f__amt", "f__month")})


@query(
    "s09_unpaired_features", "S09",
    f"""WITH {CATALOG_SQL} SELECT feature, max((split = 'train')::INT) AS in_train, max((split = 'test')::INT) AS in_test FROM catalog
        GROUP BY 1 HAVING count(DISTINCT split) = 1""",
)
def _(t):
    return st.unpaired(catalog(t))


@query(
    "s10_move_features", "S10",
    f"""WITH {CATALOG_SQL} SELECT feature, split, CASE WHEN stage = 'valid' AND feature LIKE 'large%' THEN 'sub_use' ELSE stage END AS stage FROM catalog""",
)
def _(t):
    c = catalog(t)
    return st.move_features(c, c.where(F.col("feature").startswith("large")), "valid", "sub_use")


@query(
    "s11_oof_features", "S11",
    f"""WITH {TXN_SQL}, a AS (SELECT txn_id, amt / (amt + 200000) AS p FROM txn WHERE txn_id % 3 > 0), b AS (SELECT txn_id, (txn_id * 37 % 101) / 101.0 AS p FROM txn WHERE txn_id % 3 < 2)
      SELECT txn_id, {R('coalesce(a.p, -1)', 6)} AS oof_ma, {R('coalesce(b.p, -1)', 6)} AS oof_mb FROM a FULL JOIN b USING (txn_id)""",
)
def _(t):
    d = preds(t)
    tables = {
        "ma": d.where("txn_id % 3 > 0").select("txn_id", F.col("pa").alias("prediction")),
        "mb": d.where("txn_id % 3 < 2").select("txn_id", F.col("pb").alias("prediction")),
    }
    x = st.oof_features(tables, "txn_id", "prediction")
    return x.select("txn_id", *[r(F.coalesce(n, F.lit(-1.0)), 6).alias(n) for n in ("oof_ma", "oof_mb")])


def _warehouse(t: Tables) -> wh.Warehouse:
    name = f"lens_{uuid.uuid4().hex[:12]}"
    return wh.Warehouse(t.spark, name, scratch(t.spark, name))


@query(
    "s12_table_definitions", "S12",
    "SELECT o_orderkey::DOUBLE AS id, o_totalprice AS amt, '-' AS note, 1::BIGINT AS n_tables FROM orders",
)
def _(t):
    w = _warehouse(t)
    for n in ("log_a", "log_b", "keep"):
        w.create(n, [("id", "NUMERIC", True), ("amt", "FLOAT", False)])
    w.add_column("keep", "note", "STRING")
    w.drop_tables("log_")
    w.insert("keep", t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amt")))
    n = len(w.tables())
    return w.table("keep").select(
        F.col("id").cast("double"), "amt", F.coalesce("note", F.lit("-")).alias("note"), F.lit(n).cast("long").alias("n_tables")
    )


@query(
    "s13_load_insert_query_create", "S13",
    """SELECT c_mktsegment, count(*) * 2 AS n, """ + R("sum(c_acctbal) * 2", 2) + """ AS bal FROM customer GROUP BY 1""",
)
def _(t):
    w = _warehouse(t)
    path = scratch(t.spark, "customer-load")
    st.write_csv(t.customer, path)
    w.load_csv("cust", path, CUSTOMER_SCHEMA)
    w.insert("cust", t.customer)
    w.create_as("by_segment", w.query(f"SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS bal FROM {w.name}.cust GROUP BY 1"))
    return rs(w.table("by_segment"), ["bal"], 2)


@query("s14_delete_by_values", "S14", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '3-MEDIUM')")
def _(t):
    w = _warehouse(t)
    w.create_as("orders", t.orders.select("o_orderkey", "o_orderpriority"))
    w.delete("orders", "o_orderpriority", ["5-LOW", "3-MEDIUM"])
    return w.table("orders")


@query(
    "s14_delete_by_table", "S14",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""",
)
def _(t):
    w = _warehouse(t)
    w.create_as("lines", t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"))
    w.delete("lines", "l_orderkey", t.orders.where("o_orderstatus = 'O'").select("o_orderkey"))
    return w.table("lines")


@query(
    "s15_warehouse_types", "S15",
    """SELECT name, CASE WHEN kind IN ('DOUBLE', 'FLOAT') THEN 'FLOAT' WHEN kind IN ('BIGINT', 'INTEGER') THEN 'NUMERIC'
       WHEN kind LIKE 'TIMESTAMP%' THEN 'DATE' ELSE 'STRING' END AS kind, n_values FROM
       (SELECT column_name AS name, column_type AS kind FROM (DESCRIBE SELECT * FROM lineitem)) JOIN
       (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON * INTO NAME name VALUE n_values) USING (name)""",
)
def _(t):
    """The table is made with the inferred types and loaded; every column keeps its values."""
    w, kinds = _warehouse(t), wh.inferred_types(t.lineitem)
    w.create("typed", [(n, kind, False) for n, kind in kinds])
    w.insert("typed", t.lineitem)
    counts = w.table("typed").agg(*[F.count(n).alias(n) for n, _ in kinds]).unpivot([], [n for n, _ in kinds], "name", "n_values")
    return counts.join(F.broadcast(t.spark.createDataFrame(kinds, "name string, kind string")), "name").select("name", "kind", "n_values")


@query(
    "s16_experiment_log", "S16",
    f"""SELECT n_rows, cv_score, seed, model_type FROM (SELECT count(*)::DOUBLE AS n_rows, {R('avg(o_totalprice)')} AS cv_score, 1208.0::DOUBLE AS seed, 'lgr' AS model_type FROM orders
        UNION ALL SELECT count(*)::DOUBLE, {R('avg(l_quantity)')}, 1209.0, 'lgr' FROM lineitem)""",
)
def _(t):
    w = _warehouse(t)
    w.create("train_log", wh.LOG_COLUMNS)
    for seed, (d, col) in enumerate([(t.orders, "o_totalprice"), (t.lineitem, "l_quantity")], start=1208):
        s = d.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("m")).first()
        results = {"datetime": f"run-{seed}", "n_features": 1, "n_rows": s["n"], "cv_score": s["m"]}
        results |= {f"fold{i}_score": s["m"] for i in range(1, 6)}
        params = {"seed": seed, "model_type": "lgr", "metric": "mean", "learning_rate": 0.1, "objective": "regression"}
        w.insert("train_log", wh.log_rows(t.spark, results, params))
    x = w.table("train_log")
    return x.select(F.col("n_rows").cast("double"), r("cv_score").alias("cv_score"), F.col("seed").cast("double"), "model_type")


@query("s17_prediction_csv", "S17", f"WITH {TXN_SQL} SELECT txn_id, {R('amt / (amt + 200000)', 6)} AS isFraud FROM txn WHERE split = 'test'")
def _(t):
    path = scratch(t.spark, "submission")
    st.write_predictions(preds(t).where("split = 'test'"), "txn_id", "pa", "isFraud", path)
    return rs(st.read_csv(t.spark, path, "txn_id bigint, isFraud double"), ["isFraud"], 6)
