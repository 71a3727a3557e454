"""Analytic windows: lags, trailing and leading frames, group-relative values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as ag
from ..operators import ordering as od
from ..operators import streams as st
from ..operators import windows as wi
from ..operators.attach import group_size
from ..sources.tables import TXN_AGED_SQL, TXN_SQL, Tables
from .registry import QUERIES, R, query, r, rs


@query(
    "w01_row_number", "W01",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS row_no FROM events",
)
def _(t: Tables):
    d = t.events.select("event_id", "user_id", "ts")
    return wi.row_numbers(d, ["user_id"], ["ts", "event_id"]).select("event_id", F.col("row_no").cast("int"))


@query("w01_row_number_split", "W01", QUERIES["w01_row_number"].sql)
def _(t):
    """The same with the larger users cut into slices of rows."""
    d = t.events.select("event_id", "user_id", "ts")
    x = wi.row_numbers(d, ["user_id"], ["ts", "event_id"], rows_per_split=5 + d.count() // 200)
    return x.select("event_id", F.col("row_no").cast("int"))


def _gap(a, b):
    return f"coalesce(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0), -999)::BIGINT"


@query(
    "w02_day_gaps", "W02",
    "WITH x AS (SELECT event_id, ts, "
    + ", ".join(f"lag(ts, {i}) OVER w AS p{i}, lead(ts, {i}) OVER w AS m{i}" for i in range(1, 6))
    + " FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT event_id, "
    + ", ".join(f"{_gap('ts', f'p{i}')} AS past_p{i}_diff, {_gap('ts', f'm{i}')} AS future_m{i}_diff" for i in range(1, 6))
    + ", "
    + ", ".join(f"{_gap('p1', f'p{i}')} AS past_p1_p{i}_diff, {_gap('m1', f'm{i}')} AS future_m1_m{i}_diff" for i in range(2, 6))
    + " FROM x",
)
def _(t):
    d = t.events.select("event_id", "user_id", "event_type", "ts")
    x = wi.day_gaps(d, ["user_id", "event_type"], "ts", "event_id", 5).drop("user_id", "event_type", "ts")
    return x.select("event_id", *[F.coalesce(n, F.lit(-999).cast("long")).alias(n) for n in x.columns if n != "event_id"])


@query("w02_day_gaps_split", "W02", QUERIES["w02_day_gaps"].sql)
def _(t):
    """The same with the larger groups cut into slices of rows."""
    d = t.events.select("event_id", "user_id", "event_type", "ts")
    x = wi.day_gaps(d, ["user_id", "event_type"], "ts", "event_id", 5, rows_per_split=5 + d.count() // 1000).drop("user_id", "event_type", "ts")
    return x.select("event_id", *[F.coalesce(n, F.lit(-999).cast("long")).alias(n) for n in x.columns if n != "event_id"])


_DAYS = [3, 5, 7, 14]


def _frame_sql(n):
    return f"RANGE BETWEEN {n} PRECEDING AND CURRENT ROW" if n > 0 else f"RANGE BETWEEN CURRENT ROW AND {-n} FOLLOWING"


@query(
    "w03_trailing_mean", "W03",
    "WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL), w AS (SELECT user_id, day, "
    + ", ".join(f"sum(s) OVER (PARTITION BY user_id ORDER BY day {_frame_sql(n)}) / sum(c) OVER (PARTITION BY user_id ORDER BY day {_frame_sql(n)}) AS m{n}" for n in _DAYS)
    + " FROM d) SELECT event_id, "
    + ", ".join(
        f"{R(f'm{n}')} AS day{n}_value_mean, {R(f'm{n} / (value + 1)')} AS day{n}_value_mean_org_ratio, {R(f'm{n} - value')} AS day{n}_value_mean_org_diff" for n in _DAYS
    )
    + " FROM events JOIN w ON events.user_id = w.user_id AND date_diff('day', DATE '1970-01-01', ts::DATE) = w.day",
)
def _(t):
    x = wi.attach_window_days(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", _DAYS)
    x = x.drop("user_id", "ts", "value")
    return rs(x, x.columns[1:])


@query(
    "w04_leading_mean", "W04",
    "WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL) SELECT user_id, day::INT AS day, "
    + ", ".join(
        R(f"sum(s) OVER (PARTITION BY user_id ORDER BY day {_frame_sql(-n)}) / sum(c) OVER (PARTITION BY user_id ORDER BY day {_frame_sql(-n)})") + f" AS daym{n}_value_mean" for n in _DAYS
    )
    + " FROM d",
)
def _(t):
    x = wi.window_days(t.events, ["user_id"], "ts", "value", [-n for n in _DAYS])
    return rs(x, x.columns[2:]).withColumnRenamed("_day", "day")


@query(
    "w05_trailing_amount", "W05",
    "WITH d AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, sum(o_totalprice) AS s, count(*) AS c, max(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT o_custkey, day::INT AS day, "
    + ", ".join(
        f"{R(f'sum(s) OVER f{n}', 2)} AS day{n}_o_totalprice_sum, max(x) OVER f{n} AS day{n}_o_totalprice_max, {R(f'sum(s) OVER f{n} / sum(c) OVER f{n}', 2)} AS day{n}_o_totalprice_mean" for n in (31, 180, 360)
    )
    + " FROM d WINDOW " + ", ".join(f"f{n} AS (PARTITION BY o_custkey ORDER BY day {_frame_sql(n)})" for n in (31, 180, 360)),
)
def _(t):
    x = wi.window_days(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice", [31, 180, 360], ["sum", "max", "mean"])
    return rs(x, [n for n in x.columns if n.endswith(("_sum", "_mean"))], 2).withColumnRenamed("_day", "day")


@query(
    "w06_trailing_counts", "W06",
    "WITH d AS (SELECT o_orderpriority AS product, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, count(*) AS c FROM orders GROUP BY ALL "
    "UNION ALL SELECT 'all', date_diff('day', DATE '1970-01-01', o_orderdate::DATE), count(*) FROM orders GROUP BY ALL) SELECT product, day::INT AS day, "
    + ", ".join(f"(sum(c) OVER (PARTITION BY product ORDER BY day {_frame_sql(n)}))::BIGINT AS day{n}_count" for n in (1, 3, 7, 14, 31))
    + " FROM d",
)
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("product"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    days = [1, 3, 7, 14, 31]
    per = wi.window_days(o, ["product"], "ts", "v", days, ["count"])
    every = wi.window_days(o, [], "ts", "v", days, ["count"]).withColumn("product", F.lit("all"))
    x = per.unionByName(every)
    return x.select("product", F.col("_day").alias("day"), *[F.col(f"day{n}_v_count").alias(f"day{n}_count") for n in days])


@query(
    "w06_trailing_counts_stream", "W06",
    "WITH d AS (SELECT o_orderpriority AS product, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, count(*) AS c FROM orders GROUP BY ALL "
    "UNION ALL SELECT 'all', date_diff('day', DATE '1970-01-01', o_orderdate::DATE), count(*) FROM orders GROUP BY ALL), w AS (SELECT product, day::INT AS day, "
    + ", ".join(f"(sum(c) OVER (PARTITION BY product ORDER BY day {_frame_sql(n)}))::BIGINT AS day{n}_count" for n in (1, 3, 7, 14, 31))
    + " FROM d WHERE product IS NOT NULL) SELECT * FROM w WHERE (day + 2) * 86400000000 <= (SELECT epoch_us(max(o_orderdate)) FROM orders)",
)
def _(t):
    product = F.explode(F.array("o_orderpriority", F.lit("all"))).alias("product")
    x = st.trailing_counts(t.stream("orders").select("o_orderdate", product), ["product"], "o_orderdate", [1, 3, 7, 14, 31], "day", "1 day")
    return st.drain(x, "w06").withColumnRenamed("_slot", "day")


@query(
    "w07_hour_counts_stream", "W07",
    "WITH h AS (SELECT event_type, (epoch_us(ts) // 3600000000)::INT AS hour_no, count(*) AS c FROM events WHERE event_type IS NOT NULL GROUP BY ALL), w AS (SELECT event_type, hour_no, "
    + ", ".join(f"(sum(c) OVER (PARTITION BY event_type ORDER BY hour_no {_frame_sql(n)}))::BIGINT AS hour{n}_count" for n in (1, 3, 6, 12, 18, 24))
    + " FROM h) SELECT * FROM w WHERE (hour_no + 3) * 3600000000 <= (SELECT epoch_us(max(ts)) FROM events)",
)
def _(t):
    x = st.trailing_counts(t.stream("events").select("ts", "event_type"), ["event_type"], "ts", [1, 3, 6, 12, 18, 24], "hour", "2 hours")
    return st.drain(x, "w07").withColumnRenamed("_slot", "hour_no")


_HOURS = [1, 3, 6, 12, 18, 24, -1, -3, -6, -12, -18, -24]


def _hours_sql(key, anchor):
    on = "AND x.et = b.et" if key else ""
    anchors = "SELECT et, h, max(us) AS a FROM x GROUP BY ALL" if anchor else "SELECT h, max(us) AS a FROM x GROUP BY ALL"
    using = "(et, h)" if anchor else "(h)"
    cols = ", ".join(
        f"count(*) FILTER (us BETWEEN {'a - ' + str(n) + ' * 3600000000 AND a' if n > 0 else 'a AND a + ' + str(-n) + ' * 3600000000'}) AS " + f"hour{n}_count".replace("-", "m")
        for n in _HOURS
    )
    return f"""WITH x AS (SELECT event_type AS et, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS h FROM events),
      b AS (SELECT DISTINCT et, h, a FROM x JOIN ({anchors}) USING {using})
      SELECT b.et AS event_type, b.h AS hour_no, {cols} FROM b JOIN x ON x.h BETWEEN b.h - 24 AND b.h + 25 {on} GROUP BY ALL"""


@query("w07_hour_counts", "W07", _hours_sql(True, True))
def _(t):
    return wi.window_hours(t.events.select("event_type", "ts"), ["event_type"], "ts", _HOURS)


@query("w07_hour_counts_common_anchor", "W07", _hours_sql(True, False))
def _(t):
    return wi.window_hours(t.events.select("event_type", "ts"), ["event_type"], "ts", _HOURS, anchor_keys=[])


@query(
    "w08_first_last", "W08",
    f"""WITH a AS (SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY 1)
      SELECT user_id, f AS value_first, l AS value_last, {R('l - f', 2)} AS value_diff, {R('l / (f + 10)')} AS value_ratio FROM a""",
)
def _(t):
    x = ag.first_last(t.events, ["user_id"], ["ts", "event_id"], ["value"])
    return x.withColumns({"value_diff": r("value_diff", 2), "value_ratio": r("value_ratio")})


@query(
    "w09_first_last_by_value", "W09",
    """SELECT o_orderkey, strftime(min(o_orderdate) OVER w, '%Y-%m-%d') AS first_date, strftime(max(o_orderdate) OVER w, '%Y-%m-%d') AS last_date
       FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    keys = ["o_custkey", "o_orderpriority"]
    per = o.groupBy(*keys).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"),
        group_size(),
    )
    return ag.attach(o, per, keys).select("o_orderkey", "first_date", "last_date")


@query(
    "w10_time_differences", "W10",
    f"""WITH x AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts, 1) OVER w)) / 1000000.0 AS d1, (epoch_us(ts) - epoch_us(lag(ts, 2) OVER w)) / 1000000.0 AS d2,
        (epoch_us(ts) - epoch_us(lag(ts, 3) OVER w)) / 1000000.0 AS d3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT event_id, coalesce(d1, -1) AS diff1, coalesce(d2, -1) AS diff2, coalesce(d3, -1) AS diff3,
        {R('coalesce(d1 / nullif(d2, 0), -1)', 6)} AS diff1_per_diff2, {R('coalesce(d2 / nullif(d3, 0), -1)', 6)} AS diff2_per_diff3 FROM x""",
)
def _(t):
    x = wi.time_differences(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3).drop("user_id", "ts")
    x = x.withColumns({n: F.coalesce(n, F.lit(-1.0)) for n in x.columns[1:]})
    return rs(x, ["diff1_per_diff2", "diff2_per_diff3"], 6)


@query(
    "w11_relative_to_group", "W11",
    f"""SELECT l_orderkey, l_linenumber, {R('l_extendedprice / avg(l_extendedprice) OVER w')} AS l_extendedprice_to_mean,
        {R('l_extendedprice / stddev(l_extendedprice) OVER w')} AS l_extendedprice_to_std FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    x = wi.relative_to_group(d, ["l_suppkey"], ["l_extendedprice"]).drop("l_suppkey", "l_extendedprice")
    return rs(x, x.columns[2:])


@query(
    "w12_group_zscore", "W12",
    f"WITH {TXN_SQL} SELECT txn_id, {R('coalesce((amt - avg(amt) OVER w) / nullif(stddev(amt) OVER w, 0), -99)')} AS z FROM txn WINDOW w AS (PARTITION BY uid)",
)
def _(t):
    x = wi.group_zscore(t.txn.select("txn_id", "uid", "amt"), ["uid"], "amt", "z")
    return x.select("txn_id", r(F.coalesce("z", F.lit(-99.0))).alias("z"))


@query(
    "w13_period_scaling", "W13",
    f"""WITH {TXN_SQL} SELECT txn_id, {R('(amt - min(amt) OVER w) / nullif(max(amt) OVER w - min(amt) OVER w, 0)')} AS amt_min_max,
        {R('(amt - avg(amt) OVER w) / nullif(stddev(amt) OVER w, 0)')} AS amt_std_score FROM txn WINDOW w AS (PARTITION BY month)""",
)
def _(t):
    x = wi.period_scaling(t.txn.select("txn_id", "month", "amt"), "month", ["amt"])
    return rs(x.select("txn_id", "amt_min_max", "amt_std_score"), ["amt_min_max", "amt_std_score"])


@query(
    "w14_ranks", "W14",
    """SELECT l_orderkey, l_linenumber, (rank() OVER (ORDER BY l_quantity))::DOUBLE AS rank_min,
       rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank_avg FROM lineitem""",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return od.ranked(d, "l_quantity", {"rank_min": "min", "rank_avg": "average"}).drop("l_quantity")


@query("w14_ranks_in_buckets", "W14", QUERIES["w14_ranks"].sql)
def _(t):
    """The same with the value axis cut into many buckets."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    x = od.ranked(d, "l_quantity", {"rank_min": "min", "rank_avg": "average"}, rows_per_bucket=1000)
    return x.drop("l_quantity")


@query(
    "w15_next_month_ratio", "W15",
    f"""WITH {TXN_SQL}, c AS (SELECT uid, month, count(*) AS n FROM txn GROUP BY ALL)
      SELECT a.uid, a.month::INT AS month, {R('coalesce(b.n, 0) * 1.0 / (a.n + 1)', 6)} AS next_ratio FROM c a LEFT JOIN c b ON a.uid = b.uid AND b.month = a.month + 1""",
)
def _(t):
    return rs(wi.next_period_ratio(t.txn, ["uid"], "month", "next_ratio"), ["next_ratio"], 6)


@query(
    "w16_last_per_key", "W16",
    """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    return wi.last_per_key(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "w17_jump_flag", "W17",
    """WITH x AS (SELECT event_id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS p, 1 + hour(ts) / 12.0 AS t FROM events)
       SELECT event_id, coalesce((value / nullif(abs(p), 0) > t)::INT, 0) AS jump FROM x""",
)
def _(t):
    d = t.events.select("event_id", "user_id", "ts", "value", (1 + F.hour("ts") / 12).alias("t"))
    return wi.jump_flags(d, ["user_id"], ["ts", "event_id"], {"jump": "value"}, "t").select("event_id", "jump")


@query(
    "a22_dated_window_stats", "A22",
    f"""WITH x AS (SELECT user_id, value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-24')
      SELECT user_id, min(value) AS v_min, {R('avg(value)')} AS v_mean, {R('median(value)')} AS v_median, max(value) AS v_max, count(value) AS v_count,
        {R('coalesce(stddev(value), -1)')} AS v_std,
        {R('coalesce(CASE WHEN count(value) > 2 THEN CASE WHEN isnan(skewness(value)) THEN 0 ELSE skewness(value) END END, -99)')} AS v_skew FROM x GROUP BY 1""",
)
def _(t):
    day = F.col("ts").cast("date")
    x = t.events.where(day.between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-24").cast("date"))).select("user_id", "value")
    s = ag.group_stats(x, ["user_id"], {"value": ["min", "mean", "max", "count", "std", "skew"]}).withColumnsRenamed(
        {f"value_{n}": f"v_{n}" for n in ("min", "mean", "max", "count", "std", "skew")}
    )
    med = od.exact_quantiles(x, "value", [0.5], ["user_id"]).select("user_id", F.col("quantile").alias("v_median"))
    s = s.join(med, "user_id").withColumns({"v_std": F.coalesce("v_std", F.lit(-1.0)), "v_skew": F.coalesce("v_skew", F.lit(-99.0))})
    return rs(s, ["v_mean", "v_median", "v_std", "v_skew"])
