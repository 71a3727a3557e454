"""Joins, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as ag
from ..operators import entity as en
from ..operators import filters as fl
from ..operators import windows as wi
from ..sources.tables import EV_SQL, TXN_AGED_SQL, TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import R, query, r, rs

# -- joins -------------------------------------------------------------------------


@query(
    "j01_attach_aggregate", "J01",
    f"""WITH {TXN_SQL}, a AS (SELECT uid, product, avg(amt) AS m FROM txn GROUP BY ALL)
      SELECT txn_id, {R('m')} AS amt_mean FROM txn LEFT JOIN a USING (uid, product)""",
)
def _(t: Tables):
    d = t.txn.select("txn_id", "uid", "product", "amt")
    a = ag.attach(d, ag.sized_stats(d, ["uid", "product"], {"amt": ["mean"]}), ["uid", "product"])
    return rs(a.select("txn_id", "amt_mean"), ["amt_mean"])


@query(
    "j02_inner_join", "J02",
    "SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    line = t.lineitem.select("l_orderkey", "l_linenumber")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return line.join(o, "l_orderkey")


@query(
    "j03_full_outer_counts", "J03 D09",
    f"""WITH {TXN_SQL}, a AS (SELECT uid, count(*) AS n_train FROM txn WHERE split = 'train' GROUP BY uid),
      b AS (SELECT uid, count(*) AS n_test FROM txn WHERE split = 'test' GROUP BY uid)
      SELECT uid, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test FROM a FULL JOIN b USING (uid)""",
)
def _(t):
    d = t.txn.select("uid", "split")
    one = d.where("split = 'train'").groupBy("uid").agg(F.count(F.lit(1)).alias("n_train"))
    two = d.where("split = 'test'").groupBy("uid").agg(F.count(F.lit(1)).alias("n_test"))
    return one.join(two, "uid", "outer").na.fill(0, ["n_train", "n_test"])


@query(
    "d09_both_split_counts", "D09",
    f"""WITH {TXN_SQL} SELECT uid, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM txn GROUP BY uid""",
)
def _(t):
    return fl.both_split_counts(t.txn.select("uid", "split"), "uid", "split")


@query(
    "j04_index_join", "J04",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query(
    "j05_lookup", "J05",
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    # Spark broadcasts the lookups when their size allows
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    j = c.join(t.nation, "n_nationkey", "left").withColumnRenamed("n_regionkey", "r_regionkey")
    return j.join(t.region, "r_regionkey", "left").select("c_custkey", "n_name", "r_name")


@query(
    "j06_semi_and_anti", "J06",
    """SELECT c_custkey, 1 AS has_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
       UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    c = t.customer.select("c_custkey")
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    yes = fl.members(c, o, ["c_custkey"]).withColumn("has_orders", F.lit(1))
    return yes.unionByName(fl.members(c, o, ["c_custkey"], keep=False).withColumn("has_orders", F.lit(0)))


@query(
    "j07_calendar_join", "J07",
    f"""WITH d AS (SELECT o_orderdate AS dt, count(*) AS cnt, sum(o_totalprice) AS total FROM orders GROUP BY 1),
      s AS (SELECT l_shipdate AS dt, count(*) AS shipped FROM lineitem GROUP BY 1)
      SELECT strftime(dt, '%Y-%m-%d') AS day, cnt, {R('total', 2)} AS total, coalesce(shipped, 0) AS shipped FROM d LEFT JOIN s USING (dt)""",
)
def _(t):
    d = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("dt")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("o_totalprice").alias("total")
    )
    s = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.count(F.lit(1)).alias("shipped")
    )
    j = d.join(s, "dt", "left")
    return j.select(F.col("dt").cast("string").alias("day"), "cnt", r("total", 2).alias("total"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


@query(
    "j09_hour_counter_partners", "J09 G04",
    f"""WITH {EV_SQL}, x AS (SELECT event_id, event_type, epoch_us(ts) AS t, k FROM ev)
      SELECT a.event_id, min(b.event_id) AS head, count(*) AS size FROM x a JOIN x b
      ON a.event_type = b.event_type AND trunc((b.t - a.t) / 3600000000.0) = b.k - a.k GROUP BY a.event_id""",
)
def _(t):
    return en.hour_counter_partners(t.ev, ["event_type"], "event_id", "ts", "k")


@query(
    "j10_day_counter_links", "J10",
    f"""WITH {TXN_AGED_SQL}, x AS (SELECT txn_id, product, ts::DATE - d1::INT AS reg, d1, (txn_id % 90)::INT AS d3 FROM txn_aged)
      SELECT b.txn_id, count(*) - max(b.d3 <> 0)::INT AS matches, min(a.txn_id) FILTER (a.txn_id <> b.txn_id OR b.d3 = 0) AS partner, count(*) AS set_size
      FROM x b JOIN x a ON a.product = b.product AND a.reg = b.reg AND (a.d1 = b.d1 - b.d3 OR a.txn_id = b.txn_id) AND a.d3 <> 0
      GROUP BY b.txn_id HAVING count(*) > 1""",
)
def _(t):
    d = t.txn_aged.select(
        "txn_id", "product", F.date_sub(F.col("ts").cast("date"), F.col("d1")).alias("reg"), "d1", (F.col("txn_id") % 90).cast("int").alias("d3")
    )
    return en.progress_links(d, "txn_id", ["product", "reg"], "d1", "d3")


@query(
    "j11_trailing_range", "J11",
    f"""WITH d AS (SELECT user_id, ts::DATE AS dt, sum(value) AS s FROM events GROUP BY ALL)
      SELECT a.user_id, strftime(a.dt, '%Y-%m-%d') AS day, {R('sum(b.s)', 2)} AS total FROM d a JOIN d b
      ON a.user_id = b.user_id AND b.dt BETWEEN a.dt - 7 AND a.dt GROUP BY ALL""",
)
def _(t):
    w = wi.window_days(t.events, ["user_id"], "ts", "value", [7], ["sum"])
    return w.select("user_id", F.date_from_unix_date("_day").cast("string").alias("day"), r("day7_value_sum", 2).alias("total"))


@query(
    "j12_parameter_grid", "J12",
    f"""WITH w AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS w)
      SELECT w, l_returnflag, {R('avg(w * l_discount + (1 - w) * l_tax)', 6)} AS mix FROM lineitem, w GROUP BY ALL""",
)
def _(t):
    # the grid is a literal list; rows are added up before they meet it
    per = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
    per = per.withColumn("w", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return per.select("w", "l_returnflag", r(F.col("w") * F.col("d") + (1 - F.col("w")) * F.col("x"), 6).alias("mix"))


# -- sort and top-k ------------------------------------------------------------------


@query("o01_multi_key_sort", "O01", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", F.desc("o_totalprice"))


@query(
    "o02_head_and_tail", "O02",
    """SELECT 'head' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
       UNION ALL SELECT 'tail', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    head = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select(F.lit("head").alias("side"), "o_orderkey")
    tail = o.orderBy("o_totalprice", "o_orderkey").limit(10).select(F.lit("tail").alias("side"), "o_orderkey")
    return head.unionByName(tail)


@query(
    "o03_most_frequent", "O03",
    "SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1 ORDER BY cnt DESC, l_partkey LIMIT 20",
)
def _(t):
    return fl.value_counts(t.lineitem, "l_partkey", 20)


@query(
    "o04_best_per_key", "O04",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS best FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""",
)
def _(t):
    return fl.best_per(t.lineitem, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(
    "o05_importance_selection", "O05",
    f"""WITH i AS (SELECT 'brand_' || p_brand AS feature, avg(p_retailprice) AS imp_avg FROM part GROUP BY 1)
      SELECT feature, {R('imp_avg')} AS imp_avg FROM i WHERE imp_avg > (SELECT avg(imp_avg) FROM i) ORDER BY i.imp_avg DESC, feature LIMIT 10""",
)
def _(t):
    i = t.part.groupBy(F.concat(F.lit("brand_"), "p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("imp_avg"))
    i = i.withColumn("_m", i.agg(F.avg("imp_avg")).scalar()).where("imp_avg > _m")
    return i.orderBy(F.desc("imp_avg"), "feature").limit(10).select("feature", r("imp_avg").alias("imp_avg"))


# -- set operations --------------------------------------------------------------------


@query(
    "u01_union_by_name", "U01",
    f"""WITH {TXN_SQL} SELECT txn_id, amt, coalesce(label, -1) AS label, split FROM txn""",
)
def _(t):
    d = t.txn
    train = d.where("split = 'train'").select("txn_id", "amt", "label")
    test = d.where("split = 'test'").select("amt", "txn_id")
    return fl.union_splits(train, test).withColumn("label", F.coalesce("label", F.lit(-1)))


@query("u02_distinct", "U02", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query(
    "u03_intersection", "U03",
    f"WITH {TXN_SQL} SELECT uid FROM txn WHERE split = 'train' INTERSECT SELECT uid FROM txn WHERE split = 'test'",
)
def _(t):
    d = t.txn
    return d.where("split = 'train'").select("uid").intersect(d.where("split = 'test'").select("uid"))


@query(
    "u04_difference", "U04",
    f"WITH {TXN_SQL} SELECT uid FROM txn WHERE split = 'train' EXCEPT SELECT uid FROM txn WHERE split = 'test'",
)
def _(t):
    d = t.txn
    return d.where("split = 'train'").select("uid").subtract(d.where("split = 'test'").select("uid"))
