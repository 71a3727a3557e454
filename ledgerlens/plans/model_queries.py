"""Model-shaped jobs and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import models as ml
from ..operators import sampling as sa
from ..operators import topics as tp
from ..operators import udf
from ..sources.tables import EV_SQL, Tables
from .metric_queries import auc_sql, hash_sql
from .registry import R, query, r, rs

FEATS = ["k", "value", "hr"]


def logit_sql(d: int) -> str:
    return "1 / (1 + exp(-(" + " + ".join(["b0", *(f"b{i} * x{i}" for i in range(1, d + 1))]) + ")))"


def newton_sql(d: int, models: str, logistic: bool = True, steps: int = 10) -> str:
    """CTEs that end in ``fit`` (m, held, b0..bd): models of ``nd`` (y, fold, x1..xd) by Newton steps, without the rows of fold ``held``.

    ``models`` lists (name, held, and 1 or 0 for each column that takes part). Every
    step adds up the products and solves the system column by column.
    """
    n, b = d + 1, [f"b{i}" for i in range(d + 1)]
    use = ["1", *(f"u{i}" for i in range(1, n))]
    x = ["1.0", *(f"x{i} * u{i}" for i in range(1, n))]
    eta = " + ".join(f"{b[i]} * {x[i]}" for i in range(n))
    p = f"1 / (1 + exp(-({eta})))"
    bend, slope = ("p * (1 - p)", "y - p") if logistic else ("1.0", "y")
    sums = [f"sum({bend} * z{i} * z{j})" + (f" + (1 - max({use[i]}))" if i == j else "") + f" AS a{i}{j}" for i in range(n) for j in range(n)]
    sums += [f"sum(({slope}) * z{i}) AS a{i}{n}" for i in range(n)]
    keep = ", ".join(["m", "held", "i", *use[1:], *b])
    inner = f"SELECT {keep}, y, {p if logistic else '0.0'} AS p, " + ", ".join(f"{x[i]} AS z{i}" for i in range(n))
    q = f"SELECT {keep}, {', '.join(sums)} FROM ({inner} FROM st JOIN nd ON nd.y IS NOT NULL AND nd.fold <> st.held WHERE i < {steps if logistic else 1}) GROUP BY {keep}"
    for k in range(n):
        cells = ", ".join(f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" if i != k else f"a{i}{j}" for i in range(n) for j in range(k + 1, n + 1))
        own = ", ".join(f"a{i}{i}" for i in range(k + 1))
        q = f"SELECT {keep}, {own}, {cells} FROM ({q})" if k < n - 1 else f"SELECT {keep}, {own}, {cells} FROM ({q})"
    moved = ", ".join(f"b{i} + a{i}{n} / a{i}{i}" for i in range(n))
    names = ", ".join(["m", "held", *use[1:]])
    return f"""md({names}) AS (VALUES {models}),
      st AS (SELECT {names}, 0 AS i, {", ".join(f"0.0::DOUBLE AS {c}" for c in b)} FROM md
        UNION ALL SELECT m, held, {", ".join(use[1:])}, i + 1, {moved} FROM ({q})),
      fit AS (SELECT * FROM st WHERE i = {steps if logistic else 1})"""


def _ml_frame(t: Tables):
    """Events as labelled rows; the last week is the unlabelled test side."""
    d = t.ev.withColumn("hr", F.hour("ts"))
    train = F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")
    y = F.when(train, ((F.col("value") > 20) & (F.col("k") > 30)).cast("int"))
    return sa.folds(d.select("event_id", "value", "k", "hr", y.alias("y")), "event_id", 3, 11)


ML_SQL = f"""{EV_SQL}, nd AS (SELECT event_id AS id, CASE WHEN ts < TIMESTAMP '2024-01-24' THEN (value > 20 AND k > 30)::INT END::DOUBLE AS y,
        ({hash_sql('event_id', 11)} % 3)::INT AS fold, coalesce(k, -1)::DOUBLE AS x1, coalesce(value, -1)::DOUBLE AS x2, hour(ts)::DOUBLE AS x3 FROM ev)"""


@query("l01_classifier_logistic", "L01", f"""WITH RECURSIVE {ML_SQL}, {newton_sql(3, "('all', -1, 1, 1, 1)")} SELECT id AS event_id, {R(logit_sql(3))} AS pred FROM nd, fit WHERE y IS NULL""")
def _(t):
    d = _ml_frame(t)
    m = ml.fit_classifier(d, "y", FEATS, "lgr")
    return ml.score(m, d.where("y IS NULL"), FEATS).select("event_id", r("pred").alias("pred"))


@query("l01_classifier_boosted", "L01", None)
def _(t):
    d = _ml_frame(t)
    m = ml.fit_classifier(d, "y", FEATS, "lgb", {"maxIter": 5, "maxDepth": 3})
    return ml.score(m, d.where("y IS NULL"), FEATS).select("event_id", r("pred").alias("pred"))


@query(
    "l02_regressor_linear", "L02",
    f"""WITH x AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
      SELECT event_id, {R('(SELECT regr_intercept(value, k) FROM x) + k * (SELECT regr_slope(value, k) FROM x)', 3)} AS pred FROM x""",
)
def _(t):
    d = t.ev.select("event_id", "value", "k")
    m = ml.fit_regressor(d, "value", ["k"], "linear", {"solver": "normal"})
    return ml.score(m, d, ["k"]).select("event_id", r("pred", 3).alias("pred"))


@query(
    "l02_regressor_lasso", "L02",
    f"""WITH x AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
      f AS (SELECT sign(c) * greatest(abs(c) / s - 0.1, 0) / s AS b, mk, my FROM (SELECT covar_pop(value, k) AS c, stddev_pop(k) AS s, avg(k) AS mk, avg(value) AS my FROM x))
      SELECT event_id, {R('my + b * (k - mk)', 3)} AS pred FROM x, f""",
)
def _(t):
    d = t.ev.select("event_id", "value", "k")
    m = ml.fit_regressor(d, "value", ["k"], "lasso", {"regParam": 0.1})
    return ml.score(m, d, ["k"]).select("event_id", r("pred", 3).alias("pred"))


_FOLDS = ", ".join(f"('f{v}', {v}, 1, 1, 1)" for v in range(3))


@query(
    "l03_cross_validation", "L03 M10",
    f"""WITH RECURSIVE {ML_SQL}, {newton_sql(3, _FOLDS)}
      SELECT id AS event_id, {R(f"avg({logit_sql(3)})")} AS pred FROM nd, fit WHERE y IS NULL OR fold = held GROUP BY id""",
)
def _(t):
    d = _ml_frame(t)
    pred, _ = ml.cross_validate(d, "event_id", "y", FEATS, "fold", [0, 1, 2], "lgr")
    return rs(pred, ["pred"])


_SPREAD = ", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate("qdt") for j, b in enumerate("qdt"))
_TURN = ", ".join("(" + " + ".join(f"c{i}{j} * v{j}" for j in range(3)) + f") AS w{i}" for i in range(3))
_UNIT = "sqrt(w0 * w0 + w1 * w1 + w2 * w2)"


@query(
    "l04_first_component", "L04",
    f"""WITH RECURSIVE x AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem),
      c AS (SELECT {_SPREAD} FROM x),
      p AS (SELECT 0 AS i, 1.0::DOUBLE AS v0, 1.0::DOUBLE AS v1, 1.0::DOUBLE AS v2
        UNION ALL SELECT i + 1, w0 / {_UNIT}, w1 / {_UNIT}, w2 / {_UNIT} FROM (SELECT i, {_TURN} FROM p, c WHERE i < 60)),
      f AS (SELECT v0, v1, v2, CASE WHEN abs(v0) >= abs(v1) AND abs(v0) >= abs(v2) THEN sign(v0) WHEN abs(v1) >= abs(v2) THEN sign(v1) ELSE sign(v2) END AS s FROM p WHERE i = 60)
      SELECT id, {R('s * (v0 * q + v1 * d + v2 * t)')} AS pc1 FROM x, f""",
)
def _(t):
    d = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax")
    return rs(ml.first_component(d, "id", ["l_quantity", "l_discount", "l_tax"], "pc1"), ["pc1"])


def topic_sql(counts: str, k: int, iterations: int, weight: str) -> str:
    """CTEs that end in ``shares`` for a table of (id, token, n); ``weight`` is the start weight with ``{j}`` for the topic."""
    each = lambda f, sep=", ": sep.join(f.replace("{j}", str(j)) for j in range(k))
    out = [f"w0 AS MATERIALIZED (SELECT token, {each(weight + ' AS p{j}')} FROM (SELECT DISTINCT token FROM {counts}))"]
    out.append(f"s0 AS MATERIALIZED (SELECT DISTINCT id, {each(f'(1.0::DOUBLE / {k}) AS s{{j}}')} FROM {counts})")
    for i in range(iterations):
        scaled = each(f"(p{{j}} + {tp.TOKEN_PRIOR}) / (sum(p{{j}}) OVER () + {tp.TOKEN_PRIOR} * count(*) OVER ()) AS p{{j}}")
        out.append(f"f{i} AS MATERIALIZED (SELECT token, {scaled} FROM w{i})")
        fit = each("s{j} * p{j}", " + ")
        out.append(f"r{i} AS MATERIALIZED (SELECT id, token, {each(f'n * s{{j}} * p{{j}} / ({fit}) AS p{{j}}')} FROM {counts} JOIN f{i} USING (token) JOIN s{i} USING (id))")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT token, {each('sum(p{j}) AS p{j}')} FROM r{i} GROUP BY token)")
        total = each("sum(p{j})", " + ")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT id, {each(f'(sum(p{{j}}) + {tp.DOC_PRIOR}) / ({total} + {tp.DOC_PRIOR * k}) AS s{{j}}')} FROM r{i} GROUP BY id)")
    return ", ".join(out) + f", shares AS (SELECT id, {each('s{j} AS topic_{j}')} FROM s{iterations})"


_TOPIC_SEED = 71


@query(
    "l05_topic_mixture", "L05",
    r"""WITH x AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents),
      kept AS (SELECT token FROM x WHERE token <> '' GROUP BY 1 HAVING count(*) >= 2),
      n AS MATERIALIZED (SELECT id, token, count(*) AS n FROM x WHERE token IN (SELECT token FROM kept) GROUP BY ALL), """
    + topic_sql("n", 5, 5, f"0.5 + {hash_sql("(token || ':{j}')", _TOPIC_SEED)} / 4294967296.0")
    + f" SELECT id AS doc_id, {', '.join(f'{R(f"topic_{j}")} AS topic_{j}' for j in range(5))} FROM shares",
)
def _(t):
    toks = ml.token_lists(ml.tokens_without_singletons(t.documents.select("doc_id", F.lower("text").alias("text")), "doc_id", "text"), "doc_id")
    return rs(ml.topic_mixture(toks, "doc_id", "tokens", k=5, iterations=5, seed=_TOPIC_SEED), [f"topic_{j}" for j in range(5)])


@query(
    "l05_topic_shares", "L05",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents), k AS (SELECT token FROM x WHERE token <> '' GROUP BY 1 HAVING count(*) >= 2)
      SELECT doc_id, 1.0::DOUBLE AS total FROM x WHERE token IN (SELECT token FROM k) GROUP BY 1""",
)
def _(t):
    toks = ml.token_lists(ml.tokens_without_singletons(t.documents.select("doc_id", F.lower("text").alias("text")), "doc_id", "text"), "doc_id")
    x = ml.topic_mixture(toks, "doc_id", "tokens", k=3, iterations=2)
    return x.select("doc_id", r(F.col("topic_0") + F.col("topic_1") + F.col("topic_2"), 4).alias("total"))


@query(
    "l06_tokens_without_singletons", "L06",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents), k AS (SELECT token FROM x WHERE token <> '' GROUP BY 1 HAVING count(*) >= 2)
      SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, min(token) AS first_token FROM x WHERE token IN (SELECT token FROM k) GROUP BY 1""",
)
def _(t):
    long = ml.tokens_without_singletons(t.documents, "doc_id", "text")
    return long.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_distinct"), F.min("token").alias("first_token")
    )


@query(
    "l06_token_frequency", "L06",
    r"""SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1""",
)
def _(t):
    toks = t.documents.select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


_CANDIDATES = ", ".join(f"('{n}', {v}, {a}, {b}, 1)" for n, a, b in (("base", 0, 0), ("k", 1, 0), ("value", 0, 1)) for v in range(3))


@query(
    "l08_incremental_feature_test", "L08",
    f"""WITH RECURSIVE {ML_SQL}, {newton_sql(3, _CANDIDATES)},
      p AS (SELECT m AS feature, held::VARCHAR AS fold, y, {logit_sql(3)} AS s FROM nd, fit WHERE y IS NOT NULL AND fold = held)
      SELECT feature, fold, {R('auc')} AS score FROM ({auc_sql('y', 's', 'p', 'feature, fold')})""",
)
def _(t):
    d = _ml_frame(t).where("y IS NOT NULL")
    return rs(ml.candidate_scores(d, "y", ["hr"], ["k", "value"], "fold", [0, 1, 2], "lgr", seed=3), ["score"])


@query(
    "l08_improving_features", "L08",
    f"""WITH s AS (SELECT CASE WHEN floor(l_quantity / 10) = 2 THEN 'base' ELSE 'f' || floor(l_quantity / 10)::INT END AS feature, l_returnflag AS fold, avg(l_quantity) AS score FROM lineitem GROUP BY ALL)
      SELECT a.feature, {R('avg(a.score)')} AS cv_score FROM s a JOIN s b ON a.fold = b.fold AND b.feature = 'base' WHERE a.feature <> 'base' GROUP BY 1 HAVING bool_and(a.score > b.score)""",
)
def _(t):
    m = F.floor(F.col("l_quantity") / 10)
    s = t.lineitem.select(F.when(m == 2, "base").otherwise(F.concat(F.lit("f"), m.cast("string"))).alias("feature"), F.col("l_returnflag").alias("fold"), "l_quantity")
    s = s.groupBy("feature", "fold").agg(F.avg("l_quantity").alias("score"))
    return rs(ml.improving_features(s), ["cv_score"])


@query(
    "l09_average_importance", "L09",
    f"""SELECT p_brand AS feature, {R('avg(p_size)')} AS imp_fold1, {R('avg(p_retailprice)')} AS imp_fold2, {R('(avg(p_size) + avg(p_retailprice)) / 2')} AS imp_avg FROM part GROUP BY 1""",
)
def _(t):
    i = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("imp_fold1"), F.avg("p_retailprice").alias("imp_fold2"))
    return rs(ml.average_importance(i, ["imp_fold1", "imp_fold2"]), ["imp_fold1", "imp_fold2", "imp_avg"])


@query(
    "l09_fold_importances", "L09",
    f"""WITH RECURSIVE {ML_SQL}, {newton_sql(3, "('f0', 0, 1, 1, 1), ('f1', 1, 1, 1, 1)")},
      i AS (SELECT held, unnest(['k', 'value', 'hr']) AS feature, unnest([abs(b1), abs(b2), abs(b3)]) AS imp FROM fit)
      SELECT feature, {R('max(imp) FILTER (held = 0)')} AS imp_fold1, {R('max(imp) FILTER (held = 1)')} AS imp_fold2, {R('avg(imp)')} AS imp_avg FROM i GROUP BY feature""",
)
def _(t):
    _, imp = ml.cross_validate(_ml_frame(t), "event_id", "y", FEATS, "fold", [0, 1], "lgr")
    return rs(imp, imp.columns[1:])


@query(
    "l10_points_few_values", "L10",
    "SELECT l_linenumber::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(t):
    return ml.dependence_points(t.lineitem.select("l_linenumber"), "l_linenumber")


@query(
    "l10_points_many_values", "L10",
    f"""WITH e AS (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [i / 10.0 for i in range(11)])) AS e FROM orders),
      b AS (SELECT greatest((SELECT count(*) FROM e WHERE e.e < o_totalprice) - 1, 0) AS b, o_totalprice AS v FROM orders),
      u AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_totalprice AS v FROM orders)),
      p AS (SELECT unnest([(5 + 10 * i) / 100.0 for i in range(10)])::DOUBLE AS p),
      q AS (SELECT p, max(n) AS n, max(n) * p + 0.4 + p * 0.2 AS aleph FROM p, u GROUP BY p)
      SELECT {R('median(v)', 3)} AS value, count(*)::DOUBLE AS n FROM b GROUP BY b
      UNION ALL SELECT round_even(lo.v + (hi.v - lo.v) * (aleph - floor(aleph)), 0), -1.0 FROM q JOIN u lo ON lo.i = floor(aleph) JOIN u hi ON hi.i = floor(aleph) + 1""",
)
def _(t):
    x = ml.dependence_points(t.orders.select("o_totalprice"), "o_totalprice", rounding=0)
    return x.select(r("value", 3).alias("value"), F.coalesce(F.col("n").cast("double"), F.lit(-1.0)).alias("n"))


@query(
    "l10_partial_dependence", "L10",
    f"""WITH RECURSIVE {ML_SQL}, {newton_sql(3, "('all', -1, 1, 1, 1)")}, pts AS (SELECT v, x2, x3 FROM nd, (SELECT unnest([0, 25, 50, 75, 99])::DOUBLE AS v))
      SELECT v AS value, {R(f"avg({logit_sql(3).replace('x1', 'v')})")} AS xray, count(*) AS n_rows FROM pts, fit GROUP BY v""",
)
def _(t):
    d = _ml_frame(t)
    m = ml.fit_classifier(d, "y", FEATS, "lgr")
    pts = [float(x) for x in (0, 25, 50, 75, 99)]
    x = ml.partial_dependence(m, d.select("event_id", *FEATS), FEATS, "k", pts, "event_id")
    return rs(x, ["xray"])


@query(
    "l10_dependence_profile", "L10",
    f"""WITH {EV_SQL}, x AS (SELECT CASE WHEN hour(ts) > 3 THEN hour(ts)::DOUBLE END AS hr FROM ev)
      SELECT hr AS value, count(*) AS n, (SELECT count(*) FROM x) AS n_rows, true AS is_share FROM x GROUP BY 1""",
)
def _(t):
    d = _ml_frame(t).withColumn("hr", F.when(F.col("hr") > 3, F.col("hr").cast("double")))
    m = ml.fit_classifier(d, "y", FEATS, "lgr")
    x = ml.dependence_profile(m, d.select("event_id", *FEATS), FEATS, "hr", "event_id", max_point=30)
    return x.select("value", "n", "n_rows", F.col("xray").between(0.0, 1.0).alias("is_share"))


_OTHERS_SQL = f"""{EV_SQL}, nd AS (SELECT event_id AS id, value AS y, ({hash_sql('event_id', 11)} % 3)::INT AS fold, coalesce(k, -1)::DOUBLE AS x1, hour(ts)::DOUBLE AS x2 FROM ev)"""


@query(
    "l11_predict_feature_from_others", "L11",
    f"""WITH RECURSIVE {_OTHERS_SQL}, {newton_sql(2, ", ".join(f"('f{v}', {v}, 1, 1)" for v in range(3)), logistic=False)}
      SELECT id AS event_id, {R("avg(b0 + b1 * x1 + b2 * x2)")} AS pred FROM nd, fit WHERE y IS NULL OR fold = held GROUP BY id""",
)
def _(t):
    d = _ml_frame(t)
    pred, _ = ml.cross_validate(d.withColumn("_t", F.col("value")), "event_id", "_t", ["k", "hr"], "fold", [0, 1, 2], "linear", regression=True)
    return rs(pred, ["pred"])


@query(
    "l12_calendar_forecast", "L12",
    f"""WITH d AS (SELECT ts::DATE AS ds, count(*)::DOUBLE AS y, date_diff('day', DATE '1970-01-01', ts::DATE) AS n FROM events GROUP BY ALL),
      f AS (SELECT regr_slope(y, n) AS b, regr_intercept(y, n) AS a, max(ds) AS last FROM d),
      full_d AS (SELECT ds, y, n FROM d UNION ALL SELECT (last + i::INT), NULL, date_diff('day', DATE '1970-01-01', (last + i::INT)) FROM f, range(1, 8) g(i)),
      tr AS (SELECT ds, y, a + b * n AS trend, isodow(ds) - 1 AS dow FROM full_d, f), e AS (SELECT dow, avg(y - trend) AS e FROM tr WHERE y IS NOT NULL GROUP BY 1)
      SELECT strftime(ds, '%Y-%m-%d') AS ds, {R('coalesce(y, -1)')} AS observed, {R('trend', 3)} AS trend, {R('trend + coalesce(e, 0)', 3)} AS yhat FROM tr LEFT JOIN e USING (dow)""",
)
def _(t):
    daily = t.events.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    x = ml.calendar_forecast(daily, "d", "n", horizon=7)
    return x.select(F.col("ds").cast("string").alias("ds"), r(F.coalesce("observed", F.lit(-1.0))).alias("observed"), r("trend", 3).alias("trend"), r("yhat", 3).alias("yhat"))


# -- user functions -------------------------------------------------------------------


@query("x01_map_arguments", "X01", "SELECT n_nationkey::BIGINT AS n_nationkey, length(n_name)::BIGINT AS size FROM nation")
def _(t):
    args = t.nation.select(F.col("n_nationkey").cast("long"), "n_name")
    return udf.map_arguments(t.spark, lambda n_nationkey, n_name: {"n_nationkey": n_nationkey, "size": len(n_name)}, args, "n_nationkey long, size long")


@query("x02_map_rows", "X02", f"SELECT event_id, {R('value * 2 + 1')} AS v FROM events")
def _(t):
    f = lambda b: pd.DataFrame({"event_id": b["event_id"], "v": b["value"] * 2 + 1})
    return rs(udf.map_rows(t.events.select("event_id", "value"), f, "event_id long, v double"), ["v"])


@query("x02_map_columns", "X02", f"SELECT o_orderkey, {R('o_totalprice / 7')} AS o_totalprice, {R('o_custkey / 7')} AS o_custkey FROM orders")
def _(t):
    return rs(udf.map_columns(t.orders, ["o_orderkey"], ["o_totalprice", "o_custkey"], _seventh), ["o_totalprice", "o_custkey"])


def _seventh(s: pd.Series) -> pd.Series:
    return s / 7


@query("x03_grouped_aggregate", "X03", f"SELECT user_id, count(*) AS n, {R('sum(value * value)', 2)} AS sq FROM events GROUP BY 1")
def _(t):
    def lift(g):
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "n": [len(g)], "sq": [(g["value"] ** 2).sum()]})

    def merge(g):
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "n": [g["n"].sum()], "sq": [g["sq"].sum()]})

    schema = "user_id long, n long, sq double"
    x = udf.grouped_aggregate(t.events.select("user_id", "value"), ["user_id"], lift, merge, lambda g: g, schema, schema)
    return rs(x, ["sq"], 2)


@query("x04_row_function", "X04", f"SELECT l_orderkey, l_linenumber, {R('greatest(l_discount, l_tax) - least(l_discount, l_tax)')} AS spread FROM lineitem")
def _(t):
    def spread(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a - b).abs()

    f = udf.row_function(spread, "double")
    return t.lineitem.select("l_orderkey", "l_linenumber", r(f("l_discount", "l_tax")).alias("spread"))
