"""Encoders, discretisers, scalers and label-mean encodings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import encoders as enc
from ..operators import target as tg
from ..sources.tables import TEST_FROM, TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import R, query, r, rs

LINE_KEY = ["l_orderkey", "l_linenumber"]


@query("e01_label_encode", "E01", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS label__p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS label__p_type FROM part")
def _(t: Tables):
    return enc.label_encode(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query(
    "e02_factorize", "E02",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_brand <> 'Brand#13' THEN p_brand END AS b FROM part)
       SELECT p_partkey, CASE WHEN b IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY b NULLS LAST) - 1 END AS b FROM x""",
)
def _(t):
    d = t.part.select("p_partkey", F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("b"))
    return enc.factorize(d, ["b"])


@query(
    "e03_one_hot", "E03",
    "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT AS o_orderstatus_{s}_dummie" for s in "FOP") + " FROM orders",
)
def _(t):
    return enc.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query(
    "e03_one_hot_long", "E03",
    """WITH l AS (SELECT o_orderkey, 'o_custkey' AS feature, o_custkey::VARCHAR AS level FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders),
      k AS (SELECT feature, level, row_number() OVER (ORDER BY feature, level) - 1 AS slot FROM (SELECT DISTINCT feature, level FROM l))
      SELECT o_orderkey, slot FROM l JOIN k USING (feature, level)""",
)
def _(t):
    return enc.one_hot_long(t.orders, "o_orderkey", ["o_custkey", "o_orderpriority"])


@query(
    "e04_encode_by_cardinality", "E04",
    """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS cnt__p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS label__p_brand,
       count(*) OVER (PARTITION BY p_type) AS cnt__p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS label__p_type, """
    + ", ".join(f"(p_type = '{s}')::INT AS p_type_{s}_dummie" for s in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    + ", dense_rank() OVER (ORDER BY (p_size > 25)) - 1 AS label__big FROM part",
)
def _(t):
    d = t.part.select("p_partkey", "p_brand", "p_type", (F.col("p_size") > 25).cast("string").alias("big"))
    return enc.encode_by_cardinality(d, ["p_brand", "p_type", "big"])


@query(
    "e05_sparse_levels", "E05",
    f"""WITH {TXN_WIDE_SQL}, l AS (SELECT txn_id, split, 'nation' AS feature, coalesce(nation::VARCHAR, 'nan') AS level FROM txn_wide
          UNION ALL SELECT txn_id, split, 'uid', uid::VARCHAR FROM txn_wide UNION ALL SELECT txn_id, split, 'product', product FROM txn_wide),
      k AS (SELECT feature, level, row_number() OVER (ORDER BY feature, level) - 1 AS slot FROM l GROUP BY feature, level
        HAVING count(*) FILTER (split = 'train') > 8 AND count(*) FILTER (split = 'train') * 1.0 / count(*) > 0.05 AND count(*) FILTER (split = 'train') * 1.0 / count(*) < 0.95)
      SELECT txn_id, slot FROM l JOIN k USING (feature, level)""",
)
def _(t):
    d = t.txn_wide.select("txn_id", "split", "nation", "uid", "product")
    return enc.sparse_levels(d, "txn_id", "split", ["nation", "uid", "product"], min_train=8)[1]


@query(
    "e06_quantile_bins", "E06",
    """WITH e AS (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [i / 100.0 for i in range(101)])) AS e FROM orders)
       SELECT o_orderkey, greatest((SELECT count(*) FROM e WHERE e.e < o_totalprice) - 1, 0)::INT AS bin FROM orders""",
)
def _(t):
    return enc.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 100, "bin").select("o_orderkey", "bin")


@query(
    "e06_quantile_bins_with_ties", "E06",
    """WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_quantity, [i / 100.0 for i in range(101)])) AS e FROM lineitem)
       SELECT l_orderkey, l_linenumber, greatest((SELECT count(*) FROM e WHERE e.e < l_quantity) - 1, 0)::INT AS bin FROM lineitem""",
)
def _(t):
    return enc.quantile_bins(t.lineitem.select(*LINE_KEY, "l_quantity"), "l_quantity", 100, "bin").select(*LINE_KEY, "bin")


@query(
    "e07_equal_frequency_digits", "E07",
    """WITH m AS (SELECT mode AS m FROM (SELECT nullif(value, 0) AS mode FROM events) WHERE mode IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, mode LIMIT 1),
      x AS (SELECT event_id, coalesce(nullif(value, 0), (SELECT m FROM m)) AS v FROM events),
      e AS (SELECT DISTINCT unnest(quantile_cont(v, [i / 50.0 for i in range(50)])) AS e FROM x)
      SELECT event_id, (SELECT count(*) FROM e WHERE e.e <= v)::INT AS digit FROM x""",
)
def _(t):
    d = t.events.select("event_id", F.nullif("value", F.lit(0.0)).alias("value"))
    return enc.equal_frequency_digits(d, "value", 50, "digit").select("event_id", "digit")


@query(
    "e08_scaling", "E08",
    f"""SELECT o_orderkey, {R('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())')} AS o_totalprice_minmax,
        {R('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS o_totalprice_standard FROM orders""",
)
def _(t):
    x = enc.scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice")
    return rs(x, x.columns[1:])


# -- label means -----------------------------------------------------------------------


@query(
    "t01_label_mean", "T01",
    f"WITH {TXN_WIDE_SQL}, m AS (SELECT product, avg(label) AS m FROM txn_wide GROUP BY 1) SELECT txn_id, {R('m')} AS te FROM txn_wide JOIN m USING (product)",
)
def _(t):
    return rs(tg.label_mean(t.txn.select("txn_id", "product", "label"), "product", "label", "te", few=True).select("txn_id", "te"), ["te"])


@query(
    "t02_smoothed_label_mean", "T02",
    f"""WITH {TXN_SQL}, p AS (SELECT avg(label) AS prior FROM txn), m AS (SELECT uid, avg(label) AS m, count(label) AS n FROM txn WHERE label IS NOT NULL GROUP BY 1)
      SELECT txn_id, {R('coalesce(prior * (1 - 1 / (1 + exp(-(n - 10) / 5.0))) + m / (1 + exp(-(n - 10) / 5.0)), prior)', 6)} AS te FROM txn LEFT JOIN m USING (uid), p""",
)
def _(t):
    x = tg.smoothed_label_mean(t.txn.select("txn_id", "uid", "label"), "uid", "label", "te", min_leaf=10, smoothing=5)
    return rs(x.select("txn_id", "te"), ["te"], 6)


def _loo_sql(key, min_count=0):
    prior = f"CASE WHEN n < {min_count} THEN (SELECT avg(label) FROM txn_wide) ELSE s * 1.0 / n END" if min_count else "s * 1.0 / n"
    return f"""WITH {TXN_WIDE_SQL}, c AS (SELECT {key}, month, sum(label) AS s, count(label) AS n FROM txn_wide WHERE label IS NOT NULL GROUP BY ALL),
      f AS (SELECT a.{key}, a.month, sum(b.s) AS s, sum(b.n) AS n FROM c a JOIN c b ON a.{key} = b.{key} AND a.month <> b.month GROUP BY ALL
            UNION ALL SELECT {key}, -1, sum(s), sum(n) FROM c GROUP BY ALL)
      SELECT txn_id, {R(f'coalesce({prior}, -1)')} AS te FROM txn_wide t LEFT JOIN f ON t.{key} = f.{key} AND f.month = CASE WHEN label IS NULL THEN -1 ELSE t.month END"""


@query("t03_leave_month_out", "T03", _loo_sql("uid"))
def _(t):
    x = tg.leave_period_out(t.txn.select("txn_id", "uid", "month", "label"), ["uid"], "label", "month", "te")
    return x.select("txn_id", r(F.coalesce("te", F.lit(-1.0))).alias("te"))


@query("t04_leave_month_out_min_count", "T04", _loo_sql("nation", 480))
def _(t):
    x = tg.leave_period_out(t.txn_wide.select("txn_id", "nation", "month", "label"), ["nation"], "label", "month", "te", min_count=480)
    return x.select("txn_id", r(F.coalesce("te", F.lit(-1.0))).alias("te"))


def _profile_sql(keys, periods):
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    return f"""WITH {TXN_WIDE_SQL}, y AS (SELECT *, (year(ts) - 1995)::INT AS p FROM txn_wide),
      c AS (SELECT {k}, p, sum(label) * 1.0 AS s, count(label) AS n FROM y WHERE label IS NOT NULL GROUP BY ALL),
      own AS (SELECT {k}, p AS own FROM c UNION ALL SELECT DISTINCT {k}, -1 FROM c),
      x AS (SELECT {', '.join(f'a.{x}' for x in keys)}, own, p, s, n, s / n AS m,
          sum(s) OVER (PARTITION BY {', '.join(f'a.{x}' for x in keys)}, own) / sum(n) OVER (PARTITION BY {', '.join(f'a.{x}' for x in keys)}, own) AS am,
          CASE WHEN own = -1 THEN 0.25 + 0.75 * p / {periods - 1}.0 WHEN p < own THEN 1 - (own - 1 - p) / {periods - 1}.0 ELSE 1 - (p - 1) / {periods - 1}.0 END AS w
        FROM own a JOIN c b ON {on} AND b.p <> a.own)
      SELECT {k}, own, {R('any_value(am)')} AS fraud_all_mean, count(*) FILTER (m = 0)::INT AS no_fraud_sum,
        {R('max(m) - min(m)')} AS prob_max_min_diff, {R('max(m) / (min(m) + 1)')} AS prob_max_min_ratio, {R('coalesce(stddev(m), 0)')} AS prob_std,
        {R('max(m / (am + 1)) - min(m / (am + 1))')} AS ratio_max_min_diff, {R('max(m / (am + 1)) / (min(m / (am + 1)) + 1)')} AS ratio_max_min_ratio,
        {R('coalesce(stddev(m / (am + 1)), 0)')} AS ratio_std,
        {R('coalesce(sum(w * m) / nullif(sum(w), 0), 0)')} AS prob_weighted_mean,
        {R('coalesce(sum(w * m) / nullif(sum(w), 0), 0) / (any_value(am) + 1)')} AS prob_trend,
        {R('coalesce(sum(w * m / (am + 1)) / nullif(sum(w), 0), 0)')} AS ratio_weighted_mean FROM x GROUP BY {k}, own"""


def _profile(t, keys):
    d = t.txn_wide.select(*keys, "label", (F.year("ts") - 1995).alias("p"))
    x = tg.period_profile_encoding(d, keys, "label", "p", 6).withColumn("own", F.coalesce("own", F.lit(-1)))
    return rs(x, [n for n in x.columns if n not in [*keys, "own", "no_fraud_sum"]])


@query("t05_period_profile", "T05 T06", _profile_sql(["uid"], 6))
def _(t):
    return _profile(t, ["uid"])


@query("t06_proximity_weighted_mean", "T06", _profile_sql(["nation"], 6))
def _(t):
    return _profile(t, ["nation"])


_PAIRS = list(combinations(["segment", "product", "nation"], 2))


@query(
    "t07_pair_profiles", "T07",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{'-'.join(ks)}' AS keys, {ks[0]}::VARCHAR AS k1, {ks[1]}::VARCHAR AS k2, own, fraud_all_mean, prob_std, prob_trend FROM ({_profile_sql(list(ks), 6)})" for ks in _PAIRS
    )
    + ")",
)
def _(t):
    out = None
    for ks in _PAIRS:
        x = _profile(t, list(ks)).select(
            F.lit("-".join(ks)).alias("keys"), F.col(ks[0]).cast("string").alias("k1"), F.col(ks[1]).cast("string").alias("k2"), "own", "fraud_all_mean", "prob_std", "prob_trend"
        )
        out = x if out is None else out.unionByName(x)
    return out


@query(
    "t08_label_mean_by_bin", "T08",
    f"""WITH {TXN_SQL}, e AS (SELECT DISTINCT unnest(quantile_cont(amt, [i / 20.0 for i in range(21)])) AS e FROM txn),
      x AS (SELECT *, greatest((SELECT count(*) FROM e WHERE e.e < amt) - 1, 0)::INT AS bin FROM txn),
      c AS (SELECT bin, month, sum(label) AS s, count(label) AS n FROM x WHERE label IS NOT NULL GROUP BY ALL),
      tot AS (SELECT bin, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1)
      SELECT txn_id, bin, {R('CASE WHEN label IS NULL THEN tot.s * 1.0 / tot.n ELSE (tot.s - c.s) * 1.0 / (tot.n - c.n) END')} AS te
      FROM x JOIN tot USING (bin) LEFT JOIN c ON x.bin = c.bin AND x.month = c.month""",
)
def _(t):
    d = enc.quantile_bins(t.txn.select("txn_id", "amt", "month", "label"), "amt", 20, "bin")
    return rs(tg.leave_period_out(d, ["bin"], "label", "month", "te").select("txn_id", "bin", "te"), ["te"])


_PROFILE = ["fraud_all_mean", "no_fraud_sum", "prob_std", "prob_trend", "ratio_weighted_mean"]


@query(
    "t05_attach_profile", "T05 T06",
    f"""SELECT o_orderkey AS txn_id, {', '.join(f'coalesce(p.{n}, -1)::DOUBLE AS uid_{n}' for n in _PROFILE)}
      FROM orders LEFT JOIN ({_profile_sql(['uid'], 6)}) p ON o_custkey = p.uid
        AND p.own = CASE WHEN o_orderdate < TIMESTAMP '{TEST_FROM}' THEN year(o_orderdate) - 1995 ELSE -1 END""",
)
def _(t):
    d = t.txn.select("txn_id", "uid", "label", (F.year("ts") - 1995).alias("p"))
    x = tg.attach_period_profile(d, ["uid"], "label", "p", 6, "uid_")
    x = x.withColumns({f"uid_{n}": r(f"uid_{n}") for n in _PROFILE if n != "no_fraud_sum"})
    return x.select("txn_id", *[F.coalesce(F.col(f"uid_{n}").cast("double"), F.lit(-1.0)).alias(f"uid_{n}") for n in _PROFILE])
