"""Sampling, folds, metrics and blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import ordering as od
from ..operators import quality as qu
from ..operators import sampling as sa
from ..sources.tables import TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import QUERIES, R, query, r, rs

# Stand-in predictions: rational functions of columns, equal in every engine.
A, B, C = "amt / (amt + 200000)", "(txn_id * 37 % 101) / 101.0", "(uid * 13 + txn_id) % 997 / 997.0"
PRED_SQL = f"""{TXN_WIDE_SQL}, pr AS (SELECT *, {A} AS pa, CAST({B} AS DOUBLE) AS pb, CAST({C} AS DOUBLE) AS pc FROM txn_wide)"""


def preds(t: Tables, wide: bool = False):
    d = t.txn_wide if wide else t.txn
    return d.withColumns(
        {
            "pa": F.col("amt") / (F.col("amt") + 200000),
            "pb": (F.col("txn_id") * 37 % 101) / F.lit(101.0),
            "pc": (F.col("uid") * 13 + F.col("txn_id")) % 997 / F.lit(997.0),
        }
    )


def auc_sql(label: str, score: str, src: str, by: str = "") -> str:
    """Rank-sum AUC over midranks."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {cols}sum(y) AS n_pos, sum(1 - y) AS n_neg,
        (sum(CASE WHEN y = 1 THEN mr END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc
      FROM (SELECT {cols}{label} AS y, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {cols}s) - 1) / 2.0 AS mr
            FROM (SELECT {cols}{label}, {score} AS s FROM {src} WHERE {label} IS NOT NULL)) {grp}"""


def hash_sql(key: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT"


@query(
    "m01_downsample_negatives", "M01",
    f"WITH {TXN_SQL} SELECT txn_id, label FROM txn WHERE label IS NOT NULL AND (label = 1 OR {hash_sql('txn_id', 3)} / 4294967296.0 < 0.2)",
)
def _(t: Tables):
    return sa.downsample_negatives(t.txn.where("label IS NOT NULL").select("txn_id", "label"), "label", "txn_id", 0.2, 3)


@query("m02_hash_folds", "M02", f"SELECT o_orderkey, ({hash_sql('o_orderkey', 1208)} % 5)::INT AS fold FROM orders")
def _(t):
    return sa.folds(t.orders.select("o_orderkey"), "o_orderkey", 5, 1208)


@query(
    "m02_stratified_folds", "M02",
    f"""WITH {TXN_SQL} SELECT txn_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(txn_id::VARCHAR || ':7'), txn_id) - 1) % 5)::INT AS fold
        FROM txn WHERE label IS NOT NULL""",
)
def _(t):
    return sa.stratified_folds(t.txn.where("label IS NOT NULL").select("txn_id", "label"), "txn_id", "label", 5, 7)


@query(
    "m02_group_folds", "M02",
    f"""WITH RECURSIVE {TXN_SQL}, g AS (SELECT status, row_number() OVER (ORDER BY count(*) DESC, status) AS i, count(*) AS n FROM txn GROUP BY status),
      s AS (SELECT 0::BIGINT AS i, [0, 0]::BIGINT[] AS load, NULL::VARCHAR AS status, NULL::INT AS fold
        UNION ALL SELECT g.i, CASE WHEN load[1] <= load[2] THEN [load[1] + n, load[2]] ELSE [load[1], load[2] + n] END, g.status, CASE WHEN load[1] <= load[2] THEN 0 ELSE 1 END
        FROM s JOIN g ON g.i = s.i + 1)
      SELECT txn_id, txn.status, fold FROM txn JOIN s ON txn.status = s.status""",
)
def _(t):
    return sa.group_folds(t.txn.select("txn_id", "status"), "status", 2)


@query(
    "m02_group_folds_by_user", "M02",
    f"""WITH RECURSIVE {TXN_SQL}, g AS (SELECT uid, row_number() OVER (ORDER BY count(*) DESC, uid::VARCHAR) AS i, count(*) AS n FROM txn GROUP BY uid),
      s AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS uid, NULL::INT AS fold
        UNION ALL SELECT g.i, CASE list_position(load, list_min(load)) WHEN 1 THEN [load[1] + n, load[2], load[3]] WHEN 2 THEN [load[1], load[2] + n, load[3]] ELSE [load[1], load[2], load[3] + n] END,
          g.uid, (list_position(load, list_min(load)) - 1)::INT FROM s JOIN g ON g.i = s.i + 1)
      SELECT txn_id, txn.uid, fold FROM txn JOIN s ON txn.uid = s.uid""",
)
def _(t):
    return sa.group_folds(t.txn.select("txn_id", "uid"), "uid", 3)


@query(
    "m03_month_folds", "M03",
    f"""WITH x AS (SELECT o_orderkey, year(o_orderdate) || '-' || month(o_orderdate) AS m FROM orders) SELECT o_orderkey, CASE WHEN m = '2001-8' THEN '2001-7' ELSE m END AS fold_group FROM x""",
)
def _(t):
    return t.orders.select("o_orderkey", sa.month_fold("o_orderdate", {"2001-8": "2001-7"}).alias("fold_group"))


@query(
    "m04_merged_folds", "M04",
    f"""SELECT o_orderkey, ({hash_sql('o_orderkey', 5)} % 4)::INT AS fold, CASE WHEN o_totalprice >= 300000 THEN 0 ELSE 1 END AS set_no FROM orders""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return sa.merged_folds([o.where("o_totalprice >= 300000"), o.where("o_totalprice < 300000")], "o_orderkey", 4, 5).drop("o_totalprice")


@query(
    "m05_time_holdout", "M05",
    "SELECT event_id, CASE WHEN epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) FROM events) THEN 'train' ELSE 'valid' END AS part FROM events",
)
def _(t):
    from ..functions.safe import epoch_micros

    d = t.events.select("event_id", epoch_micros("ts").alias("us"))
    return sa.time_holdout(d, "us", 0.8).drop("us")


@query("m06_auc", "M06", f"WITH {PRED_SQL}, a AS ({auc_sql('label', 'pa', 'pr')}) SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, {R('auc', 6)} AS auc FROM a")
def _(t):
    return rs(me.auc(preds(t), "label", "pa"), ["auc"], 6)


@query("m06_auc_in_buckets", "M06", QUERIES["m06_auc"].sql)
def _(t):
    """The same with the score axis cut into many buckets."""
    return rs(me.auc(preds(t), "label", "pa", rows_per_bucket=200), ["auc"], 6)


@query("m06_auc_with_ties", "M06", f"WITH {PRED_SQL}, a AS ({auc_sql('label', 'pb', 'pr')}) SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, {R('auc', 6)} AS auc FROM a")
def _(t):
    return rs(me.auc(preds(t), "label", "pb"), ["auc"], 6)


@query(
    "m07_auc_by_segment", "M07",
    f"WITH {PRED_SQL}, a AS ({auc_sql('label', 'pa', 'pr', 'uid')}) SELECT uid, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, {R('coalesce(auc, -1)', 6)} AS auc FROM a",
)
def _(t):
    x = me.auc(preds(t), "label", "pa", ["uid"])
    return x.withColumn("auc", r(F.coalesce("auc", F.lit(-1.0)), 6))


_ERR = f"""{R('sqrt(avg((amt - p) * (amt - p)))', 2)} AS rmse, {R('1 - sum((amt - p) * (amt - p)) / (var_pop(amt) * count(*))')} AS r2, {R('avg(abs((amt - p) / amt))')} AS mape"""


@query(
    "m08_errors_by_pattern", "M08",
    f"""WITH {TXN_SQL}, x AS (SELECT amt, 200000 + (txn_id % 1000) * 100.0 AS p, (isodow(ts) - 1)::VARCHAR AS dow FROM txn)
      SELECT dow, {_ERR} FROM x GROUP BY 1 UNION ALL SELECT 'all', {_ERR} FROM x""",
)
def _(t):
    x = t.txn.select("amt", (200000 + (F.col("txn_id") % 1000) * 100.0).alias("p"), F.weekday("ts").alias("dow"))
    e = me.errors_with_all(x, "amt", "p", "dow")
    return e.select("dow", r("rmse", 2).alias("rmse"), r("r2").alias("r2"), r("mape").alias("mape"))


_LANGS = ["de", "en", "es", "fr"]
_SUB_SQL = f"""s AS (SELECT toxic, n_chars / (n_chars + 2000.0) AS score, {', '.join(f"(lang = '{g}')::INT AS is_{g}" for g in _LANGS)} FROM labels JOIN documents USING (doc_id))"""


def _sub_parts():
    parts = []
    for g in _LANGS:
        for kind, cond in (("subgroup_auc", f"is_{g} = 1"), ("bpsn_auc", f"is_{g} + toxic = 1"), ("bnsp_auc", f"is_{g} + toxic <> 1")):
            parts.append(f"SELECT 'is_{g}' AS subgroup, '{kind}' AS kind, auc FROM ({auc_sql('toxic', 'score', f'(SELECT * FROM s WHERE {cond})')})")
    return " UNION ALL ".join(parts)


def _sub_frame(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return d.select("toxic", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), *[(F.col("lang") == g).cast("int").alias(f"is_{g}") for g in _LANGS])


@query(
    "m09_subgroup_aucs", "M09",
    f"""WITH {_SUB_SQL}, p AS ({_sub_parts()}) SELECT subgroup, """
    + ", ".join(f"{R(f'''max(auc) FILTER (kind = '{k}')''', 6)} AS {k}" for k in ("subgroup_auc", "bpsn_auc", "bnsp_auc"))
    + " FROM p GROUP BY 1",
)
def _(t):
    x = me.subgroup_aucs(_sub_frame(t), "toxic", "score", [f"is_{g}" for g in _LANGS])
    return rs(x, ["subgroup_auc", "bpsn_auc", "bnsp_auc"], 6)


@query(
    "m09_subgroup_metric", "M09",
    f"""WITH {_SUB_SQL}, p AS ({_sub_parts()}), k AS (SELECT kind, CASE WHEN count(auc) = count(*) THEN pow(avg(pow(auc, -5)), -0.2) END AS m FROM p GROUP BY 1),
      o AS (SELECT auc FROM ({auc_sql('toxic', 'score', 's')})),
      w AS (SELECT max(m) FILTER (kind = 'subgroup_auc') AS a, max(m) FILTER (kind = 'bpsn_auc') AS b, max(m) FILTER (kind = 'bnsp_auc') AS c FROM k)
      SELECT {R('a', 6)} AS subgroup_auc, {R('b', 6)} AS bpsn_auc, {R('c', 6)} AS bnsp_auc, {R('auc', 6)} AS overall_auc, {R('0.25 * auc + 0.75 * (a + b + c) / 3', 6)} AS final_metric FROM w, o""",
)
def _(t):
    x = me.subgroup_metric(_sub_frame(t), "toxic", "score", [f"is_{g}" for g in _LANGS])
    return rs(x, x.columns, 6)


@query(
    "m10_collect_predictions", "M10",
    f"""WITH {PRED_SQL} SELECT txn_id, {R("CASE WHEN split = 'train' THEN CASE WHEN txn_id % 2 = 0 THEN pa ELSE pb END ELSE (pa + pb) / 2 END", 6)} AS pred FROM pr""",
)
def _(t):
    d = preds(t)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    as_pred = lambda x, c: x.select("txn_id", F.col(c).alias("pred"))
    oof = [as_pred(train.where("txn_id % 2 = 0"), "pa"), as_pred(train.where("txn_id % 2 = 1"), "pb")]
    return rs(me.collect_predictions(oof, [as_pred(test, "pa"), as_pred(test, "pb")], "txn_id", "pred"), ["pred"], 6)


_W = {"ma": 0.0542, "mb": 0.1064, "mc": 0.8394}


def _models(t):
    d = preds(t)
    return {m: d.select("txn_id", F.col(c).alias("pred")) for m, c in zip(_W, ("pa", "pb", "pc"))}


@query("m11_weighted_blend", "M11", f"WITH {PRED_SQL} SELECT txn_id, {R('pa * 0.0542 + pb * 0.1064 + pc * 0.8394', 6)} AS pred FROM pr")
def _(t):
    return rs(me.blend(_models(t), _W, "txn_id", "pred"), ["pred"], 6)


_GRID = me.weight_grid(2, 0.1)


@query(
    "m12_blend_search", "M12",
    f"""WITH {PRED_SQL}, w AS (SELECT unnest([{', '.join(str(w[0]) for w in _GRID)}])::DOUBLE AS w_pa, unnest([{', '.join(str(w[1]) for w in _GRID)}])::DOUBLE AS w_pc),
      x AS (SELECT w_pa, w_pc, label, round(pa * w_pa + pc * w_pc, 9) AS sc FROM pr, w), a AS ({auc_sql('label', 'sc', 'x', 'w_pa, w_pc')})
      SELECT w_pa, w_pc, {R('auc', 5)} AS auc FROM a""",
)
def _(t):
    return rs(me.blend_search(preds(t), "label", ["pa", "pc"], 0.1), ["auc"], 5)


@query(
    "m12_best_blend", "M12",
    f"""WITH {PRED_SQL}, w AS (SELECT unnest([{', '.join(str(w[0]) for w in _GRID)}])::DOUBLE AS w_pa, unnest([{', '.join(str(w[1]) for w in _GRID)}])::DOUBLE AS w_pc),
      x AS (SELECT w_pa, w_pc, label, round(pa * w_pa + pc * w_pc, 9) AS sc FROM pr, w), a AS ({auc_sql('label', 'sc', 'x', 'w_pa, w_pc')})
      SELECT w_pa, w_pc, {R('auc', 5)} AS auc, (SELECT {R('corr(pa, pc)')} FROM pr) AS corr FROM a ORDER BY a.auc DESC, w_pa, w_pc LIMIT 1""",
)
def _(t):
    d = preds(t)
    best = me.best_blend(me.blend_search(d, "label", ["pa", "pc"], 0.1), ["pa", "pc"])
    corr = qu.correlation_pairs(d, ["pa", "pc"]).select("corr").scalar()
    return rs(rs(best, ["auc"], 5).withColumn("corr", corr), ["corr"])


@query(
    "m12_best_blend_fine", "M12",
    f"""WITH {PRED_SQL}, g AS (SELECT unnest(range(1, 49)) AS i), w AS (SELECT a.i / 50.0::DOUBLE AS w_pa, b.i / 50.0::DOUBLE AS w_pb, (50 - a.i - b.i) / 50.0::DOUBLE AS w_pc FROM g a JOIN g b ON a.i + b.i < 50),
      x AS (SELECT w_pa, w_pb, w_pc, label, round(pa * w_pa + pb * w_pb + pc * w_pc, 9) AS sc FROM pr, w WHERE label IS NOT NULL),
      n AS (SELECT w_pa, w_pb, w_pc, sc, sum(label) AS p, sum(1 - label) AS q FROM x GROUP BY ALL),
      a AS (SELECT w_pa, w_pb, w_pc, sum(p * (b + q / 2.0)) / (sum(p) * sum(q)) AS auc
        FROM (SELECT *, sum(q) OVER (PARTITION BY w_pa, w_pb, w_pc ORDER BY sc) - q AS b FROM n) GROUP BY ALL)
      SELECT w_pa, w_pb, w_pc, {R('auc', 5)} AS auc FROM a ORDER BY a.auc DESC, w_pa, w_pb, w_pc LIMIT 1""",
)
def _(t):
    return rs(me.find_best_blend(preds(t), "label", ["pa", "pb", "pc"], 0.02), ["auc"], 5)


@query(
    "m13_rank_blend", "M13",
    f"""WITH {PRED_SQL}, i AS (SELECT *, CASE WHEN nation < 5 THEN 1 ELSE 0 END AS inside FROM pr)
      SELECT txn_id, {R('rank() OVER (ORDER BY pa) * (inside * -0.4 + 0.7) + rank() OVER (ORDER BY pb) * (inside * 0.4 + 0.3)', 3)} AS blend FROM i""",
)
def _(t):
    d = preds(t, wide=True).withColumn("inside", (F.col("nation") < 5).cast("int"))
    x = me.rank_blend(d, {"pa": F.col("inside") * -0.4 + 0.7, "pb": F.col("inside") * 0.4 + 0.3}, "blend")
    return x.select("txn_id", r("blend", 3).alias("blend"))


@query(
    "m14_override_known", "M14",
    f"WITH {PRED_SQL} SELECT txn_id, {R('CASE WHEN status = ' + chr(39) + 'F' + chr(39) + ' AND uid % 10 = 0 THEN 1.0 ELSE pa END', 6)} AS pred FROM pr WHERE split = 'test'",
)
def _(t):
    d = preds(t).where("split = 'test'")
    known = d.where("uid % 10 = 0").select("txn_id", (F.col("status") == "F").cast("int").alias("known"))
    x = me.override(d.select("txn_id", F.col("pa").alias("pred")), known, "txn_id", "pred", "known")
    return rs(x, ["pred"], 6)


@query(
    "m15_rank_residual", "M15",
    f"""WITH {PRED_SQL}, x AS (SELECT txn_id, rank() OVER (ORDER BY pa) + (count(*) OVER (PARTITION BY pa) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / 2.0 AS rb FROM pr)
      SELECT txn_id, ra AS rank_a, rb AS rank_b, ra - rb AS residual FROM x""",
)
def _(t):
    d = preds(t)
    a, b = d.select("txn_id", F.col("pa").alias("pred")), d.select("txn_id", F.col("pb").alias("pred"))
    return me.rank_residual(a, b, "txn_id", "pred")


@query(
    "m16_small_entity_auc", "M16",
    f"""WITH {PRED_SQL}, sm AS (SELECT * FROM pr WHERE label IS NOT NULL AND (SELECT count(*) FROM txn t WHERE t.uid = pr.uid) <= 6), a AS ({auc_sql('label', 'pa', 'sm')})
      SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, {R('auc', 6)} AS auc FROM a""",
)
def _(t):
    return rs(me.small_entity_auc(preds(t), "uid", "label", "pa", 6), ["auc"], 6)


@query(
    "m17_class_weight", "M17",
    f"WITH {_SUB_SQL}, d AS (SELECT doc_id, toxic, (lang IN ('de', 'fr')) AS g FROM labels JOIN documents USING (doc_id)) SELECT doc_id, CASE WHEN g AND toxic = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM d",
)
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    d = d.withColumns({f"is_{g}": (F.col("lang") == g).cast("int") for g in ("de", "fr")})
    return d.select("doc_id", me.class_weight(["is_de", "is_fr"], "toxic").alias("weight"))


@query(
    "m18_residual_columns", "M18",
    f"WITH {PRED_SQL} SELECT txn_id, {R('label - pa', 6)} AS res_pa, {R('label - pb', 6)} AS res_pb, {R('label - pc', 6)} AS res_pc FROM pr WHERE label IS NOT NULL",
)
def _(t):
    d = preds(t).where("label IS NOT NULL")
    x = me.residual_columns(d, "label", ["pa", "pb", "pc"]).select("txn_id", "res_pa", "res_pb", "res_pc")
    return rs(x, ["res_pa", "res_pb", "res_pc"], 6)


@query(
    "m18_largest_disagreements", "M18",
    f"WITH {PRED_SQL} SELECT txn_id, {R('abs(pa - pc)', 6)} AS gap FROM pr WHERE label IS NOT NULL ORDER BY abs(pa - pc) DESC, txn_id LIMIT 50",
)
def _(t):
    d = preds(t).where("label IS NOT NULL")
    return rs(me.largest_disagreements(d, "pa", "pc", "txn_id", 50).select("txn_id", "gap"), ["gap"], 6)


@query(
    "l07_single_feature_auc", "L07",
    f"""WITH {PRED_SQL}, l AS (SELECT label, 'amt' AS feature, amt::DOUBLE AS v FROM pr UNION ALL SELECT label, 'uid', uid FROM pr UNION ALL SELECT label, 'pb', pb FROM pr),
      a AS ({auc_sql('label', 'v', 'l', 'feature')}) SELECT feature, {R('greatest(auc, 1 - auc)', 6)} AS auc FROM a""",
)
def _(t):
    return rs(me.feature_auc(preds(t), "label", ["amt", "uid", "pb"]), ["auc"], 6)


@query(
    "exact_quantiles_by_group", "A22 E06",
    "SELECT l_returnflag, unnest([0.1, 0.5, 0.9])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) + 1e-7, 3) AS quantile FROM lineitem GROUP BY 1",
)
def _(t):
    x = od.exact_quantiles(t.lineitem.select("l_returnflag", "l_extendedprice"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"])
    return rs(x, ["quantile"], 3)
