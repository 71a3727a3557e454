"""Grouped aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import composite_key, month_label, ratio
from ..functions.rowwise import product_plus_one
from ..operators import aggs as ag
from ..operators import entity as en
from ..operators import metrics as me
from ..sources.tables import EV_SQL, TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import R, query, r, rs

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _skew_sql(x):
    return f"CASE WHEN count({x}) > 2 THEN coalesce(CASE WHEN isnan(skewness({x})) THEN 0 ELSE skewness({x}) END, 0) END"


def entity_group_stats(t: Tables):
    """Flagship: mean and std of the amount of each transaction's grouping id, and the amount relative to it."""
    d = t.txn_wide.select("txn_id", "uid", "segment", "nation", "amt", "ts")
    d = d.withColumn("uid_day", composite_key([en.rounded_text(F.col("amt") / 100000, 1), "segment", "nation"]))
    return rs(
        ag.attach(d, ag.sized_stats(d, ["uid_day"], {"amt": ["mean", "std"]}), ["uid_day"]).select(
            "txn_id", "uid_day", "amt_mean", F.coalesce("amt_std", F.lit(-1.0)).alias("amt_std"), ratio("amt", "amt_mean").alias("amt_rel")
        ),
        ["amt_mean", "amt_std", "amt_rel"],
    )


ENTITY_SQL = f"""WITH {TXN_WIDE_SQL}, k AS (
    SELECT *, (round_even(amt / 100000, 1))::DECIMAL(38,1)::VARCHAR || '_' || segment || '_' || nation AS uid_day FROM txn_wide),
  a AS (SELECT uid_day, avg(amt) AS m, stddev(amt) AS s FROM k GROUP BY 1)
  SELECT txn_id, uid_day, {R('m')} AS amt_mean, {R('coalesce(s, -1)')} AS amt_std, {R('amt / m')} AS amt_rel FROM k JOIN a USING (uid_day)"""

query("entity_group_stats", "G08 A01 J01", ENTITY_SQL)(entity_group_stats)


@query(
    "a01_group_stats_many_keys", "A01",
    f"""WITH {TXN_WIDE_SQL} SELECT txn_id, {R('avg(amt) OVER u')} AS uid__amt_mean, max(amt) OVER u AS uid__amt_max, min(amt) OVER u AS uid__amt_min,
        {R('coalesce(stddev(amt) OVER u, -1)')} AS uid__amt_std, {R('avg(amt) OVER s')} AS "segment-product__amt_mean", max(amt) OVER s AS "segment-product__amt_max",
        min(amt) OVER s AS "segment-product__amt_min", {R('coalesce(stddev(amt) OVER s, -1)')} AS "segment-product__amt_std"
      FROM txn_wide WINDOW u AS (PARTITION BY uid), s AS (PARTITION BY segment, product)""",
)
def _(t):
    d = t.txn_wide.select("txn_id", "uid", "segment", "product", "amt")
    x = ag.attach_group_stats(d, [["uid"], ["segment", "product"]], {"amt": ["mean", "max", "min", "std"]})
    stds = [n for n in x.columns if n.endswith("_std")]
    x = x.withColumns({n: F.coalesce(n, F.lit(-1.0)) for n in stds})
    return rs(x.drop("uid", "segment", "product", "amt"), stds + [n for n in x.columns if n.endswith("_mean")])


@query(
    "a02_group_range", "A02",
    "SELECT l_suppkey, " + ", ".join(f"{R(f'max({x}) - min({x})')} AS {x}_range" for x in NUM) + " FROM lineitem GROUP BY 1",
)
def _(t):
    d = ag.group_stats(t.lineitem, ["l_suppkey"], {x: ["range"] for x in NUM})
    return rs(d, d.columns[1:])


_KEYS = ["product", "segment", "status"]


@query(
    "a03_key_combinations", "A03",
    f"WITH {TXN_WIDE_SQL} SELECT txn_id, "
    + ", ".join(
        f"""{R(f'sum(amt) OVER (PARTITION BY {", ".join(ks)})', 2)} AS "{'-'.join(ks)}__amt_sum",
            {R(f'avg(amt) OVER (PARTITION BY {", ".join(ks)})')} AS "{'-'.join(ks)}__amt_mean",
            {R(f'stddev(amt) OVER (PARTITION BY {", ".join(ks)})')} AS "{'-'.join(ks)}__amt_std" """
        for ks in ag.key_combinations(_KEYS, 2, 3)
    )
    + " FROM txn_wide",
)
def _(t):
    d = t.txn_wide.select("txn_id", *_KEYS, "amt")
    x = ag.combination_stats(d, _KEYS, 2, 3, {"amt": ["sum", "mean", "std"]}, few=True).drop(*_KEYS, "amt")
    return x.select("txn_id", *[r(F.col(f"`{n}`"), 2 if n.endswith("_sum") else 4).alias(n) for n in x.columns[1:]])


@query(
    "a04_entity_skew", "A04",
    f"""SELECT o_custkey, {R(f'coalesce({_skew_sql("o_totalprice")}, -99)')} AS o_totalprice_skew, max(o_totalprice) AS o_totalprice_max,
        min(o_totalprice) AS o_totalprice_min FROM orders GROUP BY 1""",
)
def _(t):
    d = ag.group_stats(t.orders, ["o_custkey"], {"o_totalprice": ["skew", "max", "min"]})
    return d.withColumn("o_totalprice_skew", r(F.coalesce("o_totalprice_skew", F.lit(-99.0))))


@query(
    "a05_composite_key_count", "A05",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, hour(ts), floor(value / 10)) AS n FROM events""",
)
def _(t):
    d = t.events.select("event_id", "user_id", "event_type", F.hour("ts").alias("h"), F.floor(F.col("value") / 10).alias("v"))
    return ag.counts(d, ["user_id", "event_type", "h", "v"], null_token=False).select("event_id", "n")


@query(
    "a06_count_encoding", "A06",
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY nullif(l_tax, 0)) AS n FROM lineitem",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("x"))
    return ag.counts(d, ["x"]).select("l_orderkey", "l_linenumber", "n")


@query(
    "a07_sentinel_count", "A07",
    """WITH x AS (SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '#') AS s, coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey END, -98765) AS c FROM orders)
      SELECT o_orderkey, count(*) OVER (PARTITION BY s) AS cnt__s, count(*) OVER (PARTITION BY c) AS cnt__c FROM x""",
)
def _(t):
    d = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("c")
    )
    return ag.sentinel_count(ag.sentinel_count(d, "s"), "c")


@query(
    "a08_period_share", "A08",
    f"""WITH {TXN_SQL} SELECT txn_id, {R('count(*) OVER (PARTITION BY product, month) * 1.0 / count(*) OVER (PARTITION BY month)', 6)} AS share FROM txn""",
)
def _(t):
    d = ag.period_share(t.txn.select("txn_id", "product", "month"), "product", "month", "share")
    return rs(d.select("txn_id", "share"), ["share"], 6)


_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@query(
    "a09_period_profile", "A09",
    "SELECT o_custkey, "
    + ", ".join(
        f"count(*) FILTER (year(o_orderdate) = {y}) AS y_{y}_cnt, {R(f'count(*) FILTER (year(o_orderdate) = {y}) * 1.0 / count(*)', 6)} AS y_{y}_ratio" for y in _YEARS
    )
    + " FROM orders GROUP BY 1",
)
def _(t):
    d = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"))
    x = ag.period_profile(d, "o_custkey", "y", _YEARS, "y")
    return rs(x, [f"y_{y}_ratio" for y in _YEARS], 6)


@query(
    "a10_category_share", "A10",
    f"""SELECT user_id, event_type, count(*) AS cnt, {R('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id)', 6)} AS share FROM events GROUP BY 1, 2""",
)
def _(t):
    return rs(ag.category_share(t.events, ["user_id"], "event_type"), ["share"], 6)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "a11_category_share_wide", "A11",
    "SELECT user_id, "
    + ", ".join(f"{R(f'''coalesce(nullif(count(*) FILTER (event_type = '{e}'), 0) * 1.0 / count(*), -1)''', 6)} AS share_{e}" for e in _TYPES)
    + " FROM events GROUP BY 1",
)
def _(t):
    d = ag.category_share_wide(t.events, ["user_id"], "event_type", _TYPES, "share")
    return d.select("user_id", *[r(F.coalesce(x, F.lit(-1.0)), 6).alias(x) for x in d.columns[1:]])


@query(
    "a12_category_variety", "A12",
    f"""WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n_sample FROM lineitem GROUP BY ALL)
      SELECT l_suppkey, l_partkey, n_sample, count(*) OVER (PARTITION BY l_suppkey) AS n_total,
        {R('count(*) OVER (PARTITION BY l_suppkey) * 1.0 / n_sample', 6)} AS ratio FROM c""",
)
def _(t):
    return rs(ag.category_variety(t.lineitem, ["l_suppkey"], "l_partkey"), ["ratio"], 6)


@query(
    "a13_mode_fill", "A13",
    """WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50) AS q FROM lineitem),
      m AS (SELECT q FROM x WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)
      SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT q FROM m)) AS q FROM x""",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(50.0)).alias("q"))
    return ag.mode_fill(d, "q")


@query(
    "a14_offset_from_modal_hour", "A14",
    """WITH x AS (SELECT event_id, user_id, weekofyear(ts) AS w, hour(ts) AS h FROM events),
      m AS (SELECT user_id, w, h AS best FROM x GROUP BY user_id, w, h QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY count(*) DESC, h) = 1)
      SELECT event_id, (h - best)::INT AS hour_offset FROM x JOIN m USING (user_id, w)""",
)
def _(t):
    d = t.events.select("event_id", "user_id", F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"))
    return ag.offset_from_mode(d, ["user_id", "w"], "h", "hour_offset").select("event_id", "hour_offset")


@query(
    "a15_offset_from_mean_hour", "A15",
    f"SELECT event_id, {R('hour(ts) - avg(hour(ts)) OVER (PARTITION BY user_id, weekofyear(ts))')} AS hour_offset FROM events",
)
def _(t):
    d = t.events.select("event_id", "user_id", F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"))
    return rs(ag.offset_from_mean(d, ["user_id", "w"], "h", "hour_offset").select("event_id", "hour_offset"), ["hour_offset"])


@query(
    "a16_category_maxima", "A16",
    " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS feature, max({x})::DOUBLE AS max_value FROM lineitem GROUP BY 1" for x in NUM),
)
def _(t):
    return ag.category_maxima(t.lineitem, "l_returnflag", NUM)


@query(
    "a17_label_profile", "A17",
    f"WITH {EV_SQL} SELECT user_id, "
    + ", ".join(
        f"""{R(f"coalesce(avg(label) FILTER (event_type = '{e}'), -1)")} AS {e}_mean, count(label) FILTER (event_type = '{e}') AS {e}_cnt""" for e in _TYPES
    )
    + " FROM ev GROUP BY 1",
)
def _(t):
    d = ag.label_profile(t.ev, "user_id", "event_type", "label", _TYPES)
    return d.withColumns({f"{e}_mean": r(F.coalesce(f"{e}_mean", F.lit(-1.0))) for e in _TYPES})


@query(
    "a18_mean_by_group_size", "A18",
    f"""WITH {TXN_SQL}, a AS (SELECT uid, count(label) AS cnt, avg(label) AS m FROM txn WHERE label IS NOT NULL GROUP BY 1)
      SELECT cnt, {R('max(m)')} AS max_mean, {R('avg(m)')} AS mean_mean FROM a GROUP BY 1""",
)
def _(t):
    return rs(ag.mean_by_group_size(t.txn.where("label IS NOT NULL"), "uid", "label"), ["max_mean", "mean_mean"])


@query(
    "a19_daily_zscores", "A19",
    f"""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS cnt, sum(o_totalprice) AS total FROM orders GROUP BY 1)
      SELECT strftime(day, '%Y-%m-%d') AS day, cnt, {R('total', 2)} AS total, {R('(cnt - avg(cnt) OVER ()) / stddev(cnt) OVER ()')} AS cnt_z,
        {R('(total - avg(total) OVER ()) / stddev(total) OVER ()')} AS total_z FROM d""",
)
def _(t):
    d = ag.zscored_daily(t.orders.select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"), "day", "o_totalprice")
    return d.select(F.col("day").cast("string").alias("day"), "cnt", r("total", 2).alias("total"), r("cnt_z").alias("cnt_z"), r("total_z").alias("total_z"))


@query(
    "a20_totals_with_all", "A20",
    f"""SELECT coalesce(event_type, 'all') AS event_type, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS cnt, {R('sum(value)', 2)} AS total
      FROM events GROUP BY GROUPING SETS ((event_type, ts::DATE), (ts::DATE))""",
)
def _(t):
    d = t.events.select("event_type", F.col("ts").cast("date").cast("string").alias("day"), "value")
    return ag.totals_with_all(d, "event_type", "day", [F.count(F.lit(1)).alias("cnt"), r(F.sum("value"), 2).alias("total")])


@query(
    "a21_wrapped_day_counts", "A21",
    """WITH x AS (SELECT CASE WHEN d > 365 THEN (d - 1) % 365 + 1 ELSE d END AS day, o_orderkey, o_orderpriority FROM
        (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d, * FROM orders))
      SELECT day::INT AS day, count(DISTINCT o_orderkey) AS ids, count(DISTINCT o_orderpriority) AS products FROM x GROUP BY 1""",
)
def _(t):
    d = t.orders.withColumn("d", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    return d.groupBy(ag.wrapped_day("d").alias("day")).agg(
        F.count_distinct("o_orderkey").alias("ids"), F.count_distinct("o_orderpriority").alias("products")
    )


@query(
    "a23_decayed_means", "A23",
    "WITH x AS (SELECT user_id, value, date_diff('day', ts::DATE, DATE '2024-01-31') AS age FROM events WHERE ts < TIMESTAMP '2024-01-31') SELECT user_id, "
    + ", ".join(f"{R(f'sum(value * pow({a}, age)) / sum(pow({a}, age))')} AS decay_{i}" for i, a in enumerate([0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.999, 0.9999]))
    + " FROM x GROUP BY 1",
)
def _(t):
    x = t.events.where("ts < TIMESTAMP_NTZ '2024-01-31'").withColumn("age", F.datediff(F.lit("2024-01-31").cast("date"), "ts"))
    rates = [0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.999, 0.9999]
    return x.groupBy("user_id").agg(*[r(ag.decayed_mean("value", "age", a)).alias(f"decay_{i}") for i, a in enumerate(rates)])


_RATES = [0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.999, 0.9999]
_WINDOW_SQL = "ts::DATE < DATE '2024-01-31' AND ts::DATE > DATE '2024-01-31' - 30"


@query(
    "a23_decayed_weekday_means", "A23",
    f"""WITH x AS (SELECT user_id, isodow(ts) - 1 AS dow, value, date_diff('day', ts::DATE, DATE '2024-01-31') AS age FROM events WHERE {_WINDOW_SQL})
      SELECT user_id, dow::INT AS dow, """
    + ", ".join(
        f"{R(f'sum(value * pow({a}, age)) / sum(pow({a}, age))')} AS mean_{i}, "
        + R(f"sum(value * {' * '.join(f'pow({b}, age)' for b in _RATES[: i + 1])}) / sum(pow({a}, age))")
        + f" AS compound_{i}"
        for i, a in enumerate(_RATES)
    )
    + " FROM x GROUP BY ALL",
)
def _(t):
    x = ag.dated_window(t.events, "ts", "2024-01-31", 30).withColumn("dow", F.weekday("ts"))
    stats = ag.decayed_means(x, ["user_id", "dow"], "value", "age", _RATES)
    return rs(stats, stats.columns[2:])


@query(
    "a24_weekday_stats", "A24",
    f"""SELECT user_id, (isodow(ts) - 1)::INT AS dow, min(value) AS min, {R('avg(value)')} AS mean, {R('median(value)')} AS median, max(value) AS max,
        count(*) AS count, {R('coalesce(stddev_samp(value), 0)')} AS std, {R('CASE WHEN count(*) > 2 AND stddev_samp(value) > 0 THEN skewness(value) ELSE 0 END', 3)} AS skew
      FROM events WHERE {_WINDOW_SQL} GROUP BY ALL""",
)
def _(t):
    x = ag.dated_window(t.events, "ts", "2024-01-31", 30).withColumn("dow", F.weekday("ts"))
    return rs(rs(ag.weekday_stats(x, ["user_id", "dow"], "value"), ["mean", "median", "std"]), ["skew"], 3)


@query(
    "a24_weekday_profile", "A24",
    "SELECT user_id, "
    + ", ".join(
        f"{R(f'coalesce(avg(value) FILTER (isodow(ts) = {i + 1}), 0)')} AS dow{i}_mean, coalesce(max(value) FILTER (isodow(ts) = {i + 1}), 0) AS dow{i}_max, count(*) FILTER (isodow(ts) = {i + 1}) AS dow{i}_count"
        for i in range(7)
    )
    + " FROM events GROUP BY 1",
)
def _(t):
    d = t.events.withColumn("dow", F.weekday("ts"))
    aggs = []
    for i in range(7):
        v = F.when(F.col("dow") == i, F.col("value"))
        aggs += [
            r(F.coalesce(F.avg(v), F.lit(0.0))).alias(f"dow{i}_mean"), F.coalesce(F.max(v), F.lit(0.0)).alias(f"dow{i}_max"), F.count(v).alias(f"dow{i}_count"),
        ]
    return d.groupBy("user_id").agg(*aggs)


@query(
    "a25_day_changes", "A25",
    f"""WITH v AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL),
      p AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM v)),
      x AS (SELECT a.user_id, a.v - b.v AS d FROM (SELECT * FROM v JOIN p USING (day)) a
            LEFT JOIN (SELECT * FROM v JOIN p USING (day)) b ON a.user_id = b.user_id AND b.i = a.i - 1)
      SELECT user_id, {R('coalesce(avg(abs(d)), -1)')} AS diff_mean, {R('coalesce(stddev(d), -1)')} AS diff_std,
        {R('coalesce(max(d), -1)', 2)} AS diff_max, {R('coalesce(min(d), -1)', 2)} AS diff_min FROM x GROUP BY 1""",
)
def _(t):
    d = t.events.select("user_id", F.col("ts").cast("date").alias("day"), "value")
    x = ag.day_changes(d, ["user_id"], "day", "value")
    return x.select("user_id", *[r(F.coalesce(n, F.lit(-1.0)), 2 if n in ("diff_max", "diff_min") else 4).alias(n) for n in x.columns[1:]])


@query(
    "a26_multi_month_users", "A26",
    f"WITH {TXN_SQL} SELECT uid, count(DISTINCT month) AS n_periods, count(*) AS n_rows FROM txn GROUP BY 1 HAVING count(DISTINCT month) > 1",
)
def _(t):
    return ag.multi_period_entities(t.txn, "uid", "month")


@query(
    "a27_daily_prediction_gap", "A27",
    f"""WITH {TXN_SQL}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(label) AS l, avg(amt / (amt + 200000)) AS p FROM txn WHERE label IS NOT NULL GROUP BY 1)
      SELECT day, 'label_mean' AS series, {R('l')} AS value FROM d UNION ALL SELECT day, 'pred_mean', {R('p')} FROM d""",
)
def _(t):
    d = t.txn.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "label", (F.col("amt") / (F.col("amt") + 200000)).alias("pred"))
    return rs(me.daily_prediction_gap(d, "day", "label", "pred"), ["value"])


@query("a28_entity_size", "A28", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS size FROM events")
def _(t):
    return ag.counts(t.events.select("event_id", "user_id"), ["user_id"], "size", null_token=False).select("event_id", "size")


@query(
    "a29_score_product", "A29",
    f"SELECT l_orderkey, l_linenumber, {R('(l_discount + 1) * (l_tax + 1) * (l_quantity + 1)')} AS prod, {R('l_discount + l_tax + l_quantity')} AS total FROM lineitem",
)
def _(t):
    cols = ["l_discount", "l_tax", "l_quantity"]
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", r(product_plus_one(cols)).alias("prod"), r(F.col("l_discount") + F.col("l_tax") + F.col("l_quantity")).alias("total")
    )


@query(
    "a30_amount_by_all_categories", "A30",
    f"""WITH {TXN_WIDE_SQL} SELECT product, status, segment, nation, strftime(ts, '%Y-%m') AS ym, {R('sum(amt)', 2)} AS amt_sum FROM txn_wide GROUP BY ALL""",
)
def _(t):
    d = t.txn_wide.withColumn("ym", F.date_format("ts", "yyyy-MM"))
    return rs(d.groupBy("product", "status", "segment", "nation", "ym").agg(F.sum("amt").alias("amt_sum")), ["amt_sum"], 2)


@query(
    "a31_histogram_axis", "A31",
    """WITH axis AS (SELECT unnest(range(200))::BIGINT AS bin), q AS (SELECT l_quantity::BIGINT AS bin, count(*) AS q FROM lineitem GROUP BY 1),
      n AS (SELECT l_linenumber::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT bin, coalesce(q, 0) AS l_quantity, coalesce(n, 0) AS l_linenumber FROM axis LEFT JOIN q USING (bin) LEFT JOIN n USING (bin)""",
)
def _(t):
    return ag.histogram_axis(t.lineitem, ["l_quantity", "l_linenumber"]).na.fill(0)
