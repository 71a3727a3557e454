"""Data quality, drift and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import models as ml
from ..operators import quality as qu
from ..sources.tables import EV_SQL, TXN_SQL, Tables
from .metric_queries import auc_sql, hash_sql
from .model_queries import logit_sql, newton_sql
from .registry import R, query, r, rs

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "s08_audit", "S08",
    """WITH x AS (SELECT CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_quantity END AS a, nullif(l_tax, 0) AS b FROM lineitem)
       SELECT 'a' AS feature, count(*) FILTER (a IS NULL) AS nulls, count(*) FILTER (isinf(a)) AS infs, max(a) AS max_value, min(a) AS min_value FROM x
       UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), 0, max(b), min(b) FROM x""",
)
def _(t: Tables):
    x = t.lineitem.select(
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b")
    )
    return qu.audit(x, ["a", "b"])


@query(
    "d01_constant_columns", "D01",
    """SELECT 'one' AS feature, 1 AS is_constant UNION ALL SELECT 'l_tax', (count(DISTINCT l_tax) = 1)::INT FROM lineitem
       UNION ALL SELECT 'l_linenumber', (count(DISTINCT l_linenumber) = 1)::INT FROM lineitem""",
)
def _(t):
    d = t.lineitem.select(F.lit(1).alias("one"), "l_tax", "l_linenumber")
    return qu.constant_columns(d, d.columns)


@query("d01_drop_constant", "D01", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.lit(7).alias("same"))
    return qu.drop_constant(d, d.columns)


@query(
    "d02_variances", "D02",
    " UNION ALL ".join(f"SELECT '{x}' AS feature, {R(f'var_samp({x})', 6 if x in NUM[2:] else 2)} AS variance FROM lineitem" for x in NUM),
)
def _(t):
    v = qu.variances(t.lineitem, NUM)
    fine = F.col("feature").isin(*NUM[2:])
    return v.select("feature", F.when(fine, r("variance", 6)).otherwise(r("variance", 2)).alias("variance"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "l_tax"]
_CORR_SQL = "c AS (SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS revenue, l_tax FROM lineitem)"


def _corr_frame(t):
    return t.lineitem.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).select(*_CORR)


@query(
    "d03_correlated_pairs", "D03",
    f"WITH {_CORR_SQL}, p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM c" for a, b in combinations(_CORR, 2))
    + f") SELECT col_a, col_b, {R('corr')} AS corr FROM p WHERE abs(corr) >= 0.9",
)
def _(t):
    p = qu.correlation_pairs(_corr_frame(t), _CORR).where(F.abs("corr") >= 0.9)
    return rs(p, ["corr"])


@query(
    "d04_kept_columns", "D04",
    f"""WITH RECURSIVE {_CORR_SQL}, p AS ("""
    + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, abs(corr({x}, {y})) >= 0.9 AS hit FROM c" for (i, x), (j, y) in combinations(list(enumerate(_CORR)), 2))
    + f"""), s AS (SELECT -1 AS i, []::INT[] AS gone UNION ALL
        SELECT i + 1, CASE WHEN list_contains(gone, i + 1) THEN gone ELSE list_concat(gone, coalesce((SELECT list(b) FROM p WHERE a = i + 1 AND hit), [])) END
        FROM s WHERE i + 1 < {len(_CORR)})
      SELECT f AS feature, NOT list_contains((SELECT gone FROM s ORDER BY i DESC LIMIT 1), n - 1) AS kept
      FROM (SELECT unnest({_CORR!r}) AS f, unnest(range(1, {len(_CORR) + 1})) AS n)""",
)
def _(t):
    d = _corr_frame(t)
    gone = qu.covered_columns(d, _CORR, 0.9)
    return t.spark.createDataFrame([(x, x not in gone) for x in _CORR], "feature string, kept boolean")


@query("d04_remove_columns", "D04 D03 D02", f"WITH {_CORR_SQL} SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM c")
def _(t):
    d = _corr_frame(t).withColumn("flat", F.lit(3.0))
    return qu.remove_columns(d, d.columns, 0.0, 0.9, only_var=False)


@query(
    "d05_ranked_partners", "D05",
    f"WITH {_CORR_SQL}, p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM c" for a in _CORR for b in _CORR if a != b)
    + f") SELECT col_a, col_b, {R('corr')} AS corr, (row_number() OVER (PARTITION BY col_a ORDER BY abs(round(corr, 9)) DESC, col_b))::INT AS rank FROM p",
)
def _(t):
    return rs(qu.ranked_partners(_corr_frame(t), _CORR), ["corr"])


@query(
    "d05_correlation_matrix", "D05 D03",
    f"WITH {_CORR_SQL} "
    + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS corr FROM c" for a, b in combinations(_CORR, 2)),
)
def _(t):
    # tiles of two columns, so that pairs within a tile and across tiles are both there
    return rs(qu.correlation_pairs(_corr_frame(t), _CORR, tile=2), ["corr"])


_GAPS = ["quantity", "price", "discount", "tax", "line", "same"]
_GAPS_SQL = """c AS (SELECT l_quantity AS quantity, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, CASE WHEN l_quantity < 40 THEN l_discount END AS discount,
      CASE WHEN l_linenumber > 2 THEN l_tax END AS tax, l_linenumber AS line, CASE WHEN l_linenumber < 3 THEN 7.5 END AS same FROM lineitem)"""


def _gaps_frame(t):
    line = F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_quantity").alias("quantity"), F.when(line != 3, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_quantity") < 40, F.col("l_discount")).alias("discount"),
        F.when(line > 2, F.col("l_tax")).alias("tax"), line.alias("line"), F.when(line < 3, 7.5).alias("same"),
    )


def _gaps_pairs(pairs):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT CASE WHEN isnan(r) THEN NULL ELSE r END FROM (SELECT corr({a}, {b}) AS r FROM c)) AS corr" for a, b in pairs
    )


@query("d03_pairs_with_gaps", "D03", f"WITH {_GAPS_SQL}, p AS ({_gaps_pairs(combinations(_GAPS, 2))}) SELECT col_a, col_b, {R('corr')} AS corr FROM p")
def _(t):
    return rs(qu.correlation_pairs(_gaps_frame(t), _GAPS, tile=4), ["corr"])


@query(
    "d05_partners_with_gaps", "D05",
    f"""WITH {_GAPS_SQL}, p AS ({_gaps_pairs([(a, b) for a in _GAPS for b in _GAPS if a != b])})
      SELECT col_a, col_b, {R('corr')} AS corr, (row_number() OVER (PARTITION BY col_a ORDER BY abs(round(corr, 9)) DESC NULLS LAST, col_b))::INT AS rank FROM p""",
)
def _(t):
    return rs(qu.ranked_partners(_gaps_frame(t), _GAPS), ["corr"])


@query(
    "d06_label_correlation", "D06",
    f"""WITH {EV_SQL}, x AS (SELECT label, coalesce(value, 0) AS value, hour(ts) AS hr, k FROM ev), p AS (
      SELECT 'value' AS feature, corr(label, value) AS corr FROM x UNION ALL SELECT 'hr', corr(label, hr) FROM x UNION ALL SELECT 'k', corr(label, k) FROM x)
      SELECT feature, {R('corr')} AS corr FROM p""",
)
def _(t):
    d = t.ev.select("label", "value", F.hour("ts").alias("hr"), "k")
    return rs(qu.label_correlation(d, "label", ["value", "hr", "k"]), ["corr"])


@query(
    "d06_best_candidate", "D06",
    f"""WITH {EV_SQL}, p AS (SELECT 'value' AS base, 'value_raw' AS feature, corr(label, value) AS c FROM ev UNION ALL SELECT 'value', 'value_log', corr(label, ln(1 + value)) FROM ev
        UNION ALL SELECT 'k', 'k_raw', corr(label, k) FROM ev UNION ALL SELECT 'k', 'k_square', corr(label, k * k) FROM ev)
      SELECT base, feature, {R('abs(c)')} AS corr FROM p QUALIFY row_number() OVER (PARTITION BY base ORDER BY abs(c) DESC, feature) = 1""",
)
def _(t):
    d = t.ev.select(
        "label", F.col("value").alias("value_raw"), F.log1p("value").alias("value_log"), F.col("k").alias("k_raw"), (F.col("k") * F.col("k")).alias("k_square")
    )
    corrs = qu.label_correlation(d, "label", ["value_raw", "value_log", "k_raw", "k_square"])
    return rs(qu.best_candidate(corrs, ["value", "k_"]).withColumn("base", F.rtrim("base", F.lit("_"))), ["corr"])


def _ks_sql(col):
    return f"""SELECT '{col}' AS feature, max(abs(a * 1.0 / na - b * 1.0 / nb)) AS ks, max(na) AS n_train, max(nb) AS n_test FROM (
      SELECT v, sum(sum(tr)) OVER (ORDER BY v) AS a, sum(sum(1 - tr)) OVER (ORDER BY v) AS b, sum(sum(tr)) OVER () AS na, sum(sum(1 - tr)) OVER () AS nb
      FROM (SELECT {col} AS v, (split = 'train')::INT AS tr FROM x WHERE {col} IS NOT NULL) GROUP BY v)"""


@query(
    "d07_two_sample_ks", "D07",
    f"""WITH {TXN_SQL}, x AS (SELECT split, amt, month(ts) AS mon, uid FROM txn), k AS ({_ks_sql('amt')} UNION ALL {_ks_sql('mon')} UNION ALL {_ks_sql('uid')}),
      l AS (SELECT *, (sqrt(n_train * n_test * 1.0 / (n_train + n_test)) + 0.12 + 0.11 / sqrt(n_train * n_test * 1.0 / (n_train + n_test))) * ks AS lam FROM k),
      p AS (SELECT feature, ks, n_train, n_test, CASE WHEN any_value(lam) < 0.04 THEN 1 ELSE greatest(0, least(1, 2 * sum(pow(-1, i - 1) * exp(-2 * lam * lam * i * i)))) END AS p
        FROM l, range(1, 101) g(i) GROUP BY ALL)
      SELECT feature, {R('ks', 6)} AS ks, n_train::BIGINT AS n_train, n_test::BIGINT AS n_test, {R('p')} AS p_value, (p >= 0.1)::INT AS keep FROM p""",
)
def _(t):
    d = t.txn.select("split", "amt", F.month("ts").alias("mon"), "uid")
    x = qu.ks_two_sample(d, "split", ["amt", "mon", "uid"])
    return x.withColumns({"ks": r("ks", 6), "p_value": r("p_value")})


@query(
    "d08_adversarial_validation", "D08",
    f"""WITH RECURSIVE {TXN_SQL}, half AS (SELECT (split = 'test')::INT::DOUBLE AS side, {hash_sql('txn_id', 5)} / 4294967296.0 < 0.5 AS seen, amt, month(ts) AS mon, uid FROM txn),
      nd AS (SELECT CASE WHEN seen THEN side END AS y, side, 0 AS fold, amt::DOUBLE AS x1, mon::DOUBLE AS x2, uid::DOUBLE AS x3 FROM half), {newton_sql(3, "('all', -1, 1, 1, 1)")},
      p AS (SELECT side, {logit_sql(3)} AS s FROM nd, fit WHERE y IS NULL)
      SELECT {R('auc')} AS auc, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg FROM ({auc_sql('side', 's', 'p')})""",
)
def _(t):
    d = t.txn.select("txn_id", "split", "amt", F.month("ts").alias("mon"), "uid")
    return rs(ml.adversarial_auc(d, "split", ["amt", "mon", "uid"], "txn_id"), ["auc"])


@query(
    "d10_prediction_correlation", "D10",
    f"""WITH {TXN_SQL}, p AS (SELECT txn_id, amt / (amt + 200000) AS a, (txn_id * 37 % 101) / 101.0 AS b, amt * amt AS c FROM txn)
      SELECT 'sub_b' AS model, {R('corr(a, b)')} AS corr FROM p UNION ALL SELECT 'sub_c', {R('corr(a, c)')} FROM p""",
)
def _(t):
    d = t.txn
    p = lambda e: d.select("txn_id", F.expr(e).cast("double").alias("pred"))
    earlier = [("sub_b", p("(txn_id * 37 % 101) / 101.0D")), ("sub_c", p("amt * amt"))]
    return rs(qu.prediction_correlation(p("amt / (amt + 200000D)"), earlier, "txn_id", "pred"), ["corr"])


@query(
    "d11_winsorise", "D11",
    """WITH z AS (SELECT event_id, value, (value - avg(value) OVER ()) / stddev(value) OVER () AS z FROM events),
       b AS (SELECT max(value) FILTER (z <= 2) AS hi, min(value) FILTER (z >= -2) AS lo FROM z)
       SELECT event_id, CASE WHEN z > 2 THEN hi WHEN z < -2 THEN lo ELSE value END AS value FROM z, b""",
)
def _(t):
    return qu.winsorise(t.events.select("event_id", "value"), "value", 2.0)
