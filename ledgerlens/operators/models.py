"""Model-shaped jobs: linear and logistic models by normal equations, the others by Spark ML.

``lgb`` and ``cat`` are gradient-boosted trees, ``rmf`` random forests; parameters
are those of the Spark estimators. ``lgr`` and ``linear`` without parameters have no
penalty and are fitted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, day_number
from ..session import cut
from . import newton, topics
from .attach import SIZE, attach, group_size
from .metrics import auc, collect_predictions
from .newton import Linear
from .ordering import exact_quantiles, running_totals
from .sampling import hash_unit

CLASSIFIERS = {
    "lgr": lambda p: LogisticRegression(**{"maxIter": 20, **p}),
    "rmf": lambda p: RandomForestClassifier(**{"numTrees": 20, "seed": 1208, **p}),
    "lgb": lambda p: GBTClassifier(**{"maxIter": 10, "maxDepth": 4, "seed": 1208, **p}),
    "cat": lambda p: GBTClassifier(**{"maxIter": 10, "maxDepth": 4, "seed": 1208, **p}),
}
REGRESSORS = {
    "linear": lambda p: LinearRegression(**{"maxIter": 20, **p}),
    "ridge": lambda p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "lasso": lambda p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, **p}),
    "rmf": lambda p: RandomForestRegressor(**{"numTrees": 20, "seed": 1208, **p}),
    "lgb": lambda p: GBTRegressor(**{"maxIter": 10, "maxDepth": 4, "seed": 1208, **p}),
}


def assemble(df: DataFrame, cols: Sequence[str], fill: float = -1.0) -> DataFrame:
    """Feature vector ``_x`` with missing values filled."""
    x = df.withColumns({f"_f{i}": F.coalesce(c(n).cast("double"), F.lit(fill)) for i, n in enumerate(cols)})
    names = [f"_f{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(x).drop(*names)


def fit_classifier(train: DataFrame, label: str, cols: Sequence[str], model: str = "lgr", params: dict | None = None, weight: str | None = None):
    if model == "lgr" and not params:
        return newton.fit_one(train, label, cols, weight=weight)
    p = dict(params or {})
    if weight:
        p["weightCol"] = weight
    est = CLASSIFIERS[model](p).setLabelCol("_y").setFeaturesCol("_x")
    return est.fit(assemble(train.where(c(label).isNotNull()).withColumn("_y", c(label).cast("double")), cols))


def fit_regressor(train: DataFrame, label: str, cols: Sequence[str], model: str = "linear", params: dict | None = None):
    if model == "linear" and not params:
        return newton.fit_one(train, label, cols, logistic=False)
    est = REGRESSORS[model](dict(params or {})).setLabelCol("_y").setFeaturesCol("_x")
    return est.fit(assemble(train.where(c(label).isNotNull()).withColumn("_y", c(label).cast("double")), cols))


def score(model, df: DataFrame, cols: Sequence[str], out: str = "pred") -> DataFrame:
    """Attach the probability of class 1 (the prediction for regressors)."""
    if isinstance(model, Linear):
        return df.withColumn(out, model.score())
    s = model.transform(assemble(df, cols))
    p = vector_to_array("probability")[1] if "probability" in s.columns else F.col("prediction")
    return s.select(*df.columns, p.alias(out))


def importance(model, cols: Sequence[str]) -> list[tuple[str, float]]:
    if isinstance(model, Linear):
        return [(n, abs(b)) for n, b in zip(cols, model.coefficients)]
    v = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return [(n, abs(float(x))) for n, x in zip(cols, v.toArray())]


def importance_table(spark, folds: Sequence[Sequence[tuple[str, float]]]) -> DataFrame:
    """(feature, imp_fold1.., imp_avg); as long as the feature list."""
    per = [dict(f) for f in folds]
    names = list(per[0])
    rows = [(n, *[p[n] for p in per], sum(p[n] for p in per) / len(per)) for n in names]
    cols = ", ".join(f"imp_fold{i + 1} double" for i in range(len(per)))
    return spark.createDataFrame(rows, f"feature string, {cols}, imp_avg double")


def average_importance(df: DataFrame, folds: Sequence[str]) -> DataFrame:
    return df.withColumn("imp_avg", sum(c(f) for f in folds) / len(folds))


def _fold_models(df: DataFrame, label: str, designs: Sequence[Sequence[str]], fold: str, fold_values: Sequence, model: str, params: dict | None, regression: bool) -> list[list]:
    """Per column list the models without each fold, on a frame that is prepared and written once."""
    if model == ("linear" if regression else "lgr") and not params:
        return newton.fit_many(df, label, designs, not regression, fold, fold_values)
    fit = fit_regressor if regression else fit_classifier
    names = dict.fromkeys([label, fold, *(x for d in designs for x in d)])
    frame = cut(df.where(c(label).isNotNull()).select(*map(c, names)))
    return [[fit(frame.where(c(fold) != F.lit(v)), label, d, model, params) for v in fold_values] for d in designs]


def cross_validate(
    df: DataFrame, key: str, label: str, cols: Sequence[str], fold: str, fold_values: Sequence, model: str = "lgr", params: dict | None = None, regression: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions plus fold-mean test predictions, and the importance table."""
    models = _fold_models(df, label, [cols], fold, fold_values, model, params, regression)[0]
    importances = importance_table(df.sparkSession, [importance(m, cols) for m in models])
    if all(isinstance(m, Linear) for m in models):
        # One projection: a labelled row takes the model without its fold, an unlabelled one the mean.
        own = F.lit(None).cast("double")
        for v, m in zip(fold_values, models):
            own = F.when(c(fold) == F.lit(v), m.score()).otherwise(own)
        mean = sum(m.score() for m in models) / len(models)
        pred = df.select(key, c(fold).isin(*fold_values).alias("_in"), c(label).isNull().alias("_test"), F.when(c(label).isNull(), mean).otherwise(own).alias("pred"))
        return pred.where("_test OR _in").select(key, "pred"), importances
    train, test = df.where(c(label).isNotNull()), df.where(c(label).isNull())
    oof = [score(m, train.where(c(fold) == F.lit(v)), cols).select(key, "pred") for v, m in zip(fold_values, models)]
    return collect_predictions(oof, [score(m, test, cols).select(key, "pred") for m in models], key, "pred"), importances


def adversarial_auc(df: DataFrame, split: str, cols: Sequence[str], key: str, model: str = "lgr") -> DataFrame:
    """How well a model tells train from test: out-of-sample AUC on the hashed half."""
    x = df.withColumn("_side", (c(split) == "test").cast("int")).withColumn("_half", hash_unit(key, 5) < 0.5)
    m = fit_classifier(x.where("_half"), "_side", cols, model)
    return auc(score(m, x.where("not _half"), cols), "_side", "pred").select("auc", "n_pos", "n_neg")


def first_component(df: DataFrame, id_col: str, cols: Sequence[str], out: str, fill: float = -1.0) -> DataFrame:
    """First principal component of a block; the sign makes the largest loading positive."""
    x = assemble(df.select(id_col, *cols), cols, fill)
    m = PCA(k=1, inputCol="_x", outputCol="_p").fit(x)
    load = m.pc.toArray()[:, 0]
    sign = 1.0 if load[abs(load).argmax()] >= 0 else -1.0
    return m.transform(x).select(id_col, (vector_to_array("_p")[0] * sign).alias(out))


def topic_mixture(docs: DataFrame, id_col: str, tokens: str, k: int = 5, iterations: int = 10, seed: int = 71) -> DataFrame:
    """One column per topic with the document's share; every token takes part."""
    return topics.topic_shares(docs, id_col, tokens, k, iterations, seed)


# An id with more rows than this has its tokens looked up one by one.
ROWS_PER_ID = 64


def tokens_without_singletons(docs: DataFrame, id_col: str, text: str, at_least: int = 2, rows_per_id: int = ROWS_PER_ID) -> DataFrame:
    """Long tokens (id, pos, token) without tokens seen fewer than ``at_least`` times overall.

    A token seen once has one place, known from the pass that counts it. So with the
    usual limit of two only the texts meet the few places to leave out, by id, and
    their tokens are split where they end up. Rows without an id, of an id with many
    rows, and other limits look up every token.
    """
    docs = docs.select(c(id_col), c(text).alias("_text")).where("_text IS NOT NULL")
    freq = _long_tokens(docs, id_col).groupBy("token").agg(group_size(), F.min(id_col).alias("_id"), F.min("pos").alias("_pos"))
    if at_least != 2:
        return _frequent(_long_tokens(docs, id_col), freq, at_least)
    many = docs.groupBy(id_col).count().where((F.col("count") > rows_per_id) | c(id_col).isNull()).select(id_col)
    if many.isEmpty():
        return _without_places(docs, freq, id_col)
    known = _without_places(docs.join(many, id_col, "left_anti").where(c(id_col).isNotNull()), freq, id_col)
    rest = docs.where(c(id_col).isNull()).unionByName(docs.join(many, id_col, "left_semi"))
    return known.unionByName(_frequent(_long_tokens(rest, id_col), freq, at_least))


def _words() -> Column:
    return F.split("_text", r"\s+")


def _long_tokens(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(_words()).alias("pos", "token")).where("token <> ''")


def _frequent(long: DataFrame, freq: DataFrame, at_least: int) -> DataFrame:
    freq = freq.select("token", SIZE, (F.col(SIZE) >= at_least).alias("_keep"))
    return attach(long, freq, ["token"]).where("_keep").drop("_keep")


def _without_places(docs: DataFrame, freq: DataFrame, id_col: str) -> DataFrame:
    """Long tokens but for those seen once; a place counts in the row of its id that holds the token there."""
    once = freq.where(F.col(SIZE) == 1).groupBy("_id").agg(F.collect_list(F.struct("_pos", "token")).alias("_once"))
    # split after the join, so that the exchange holds the texts
    x = docs.join(once, c(id_col) == F.col("_id"), "left").select(id_col, _words().alias("_words"), "_once")
    here = F.transform(F.filter("_once", lambda e: F.get("_words", e["_pos"]) == e["token"]), lambda e: e["_pos"])
    left = F.array_except(F.sequence(F.lit(0), F.size("_words") - 1), F.coalesce(here, F.array().cast("array<int>")))
    kept = F.transform(left, lambda p: F.struct(p.alias("pos"), F.get("_words", p).alias("token")))
    return x.select(id_col, F.explode(kept).alias("_e")).select(id_col, "_e.pos", "_e.token").where("token <> ''")


def token_lists(long: DataFrame, id_col: str, out: str = "tokens") -> DataFrame:
    per = F.sort_array(F.collect_list(F.struct("pos", "token")))
    return long.groupBy(id_col).agg(F.transform(per, lambda e: e["token"]).alias(out))


# -- incremental tests and partial dependence ------------------------------------------


def candidate_scores(
    df: DataFrame, label: str, base: Sequence[str], candidates: Sequence[str], fold: str, fold_values: Sequence, model: str = "lgr", seed: int = 0
) -> DataFrame:
    """(feature, fold, score): AUC of base and of base plus one candidate per held-out fold.

    The base is listed as ``base``. Candidates are listed in seeded random order. All
    models of the linear kind share every pass over one written frame; then one pass
    scores each row by the models without its fold, and all AUCs are one aggregate.
    """
    import random

    order = list(candidates)
    random.Random(seed).shuffle(order)
    names = ["base", *order]
    designs = [[*base] if n == "base" else [*base, n] for n in names]
    models = _fold_models(df, label, designs, fold, fold_values, model, None, False)
    rows = df.where(c(label).isNotNull() & c(fold).isin(*fold_values))
    if all(isinstance(m, Linear) for ms in models for m in ms):
        scored = []
        for n, ms in zip(names, models):
            own = F.lit(None).cast("double")
            for v, m in zip(fold_values, ms):
                own = F.when(c(fold) == F.lit(v), m.score()).otherwise(own)
            scored.append(F.struct(F.lit(n).alias("feature"), own.alias("pred")))
        long = rows.select(c(fold).cast("string").alias("fold"), c(label).alias("_y"), F.explode(F.array(*scored)).alias("_s"))
        return auc(long.select("_s.feature", "fold", "_y", "_s.pred"), "_y", "pred", ["feature", "fold"]).select("feature", "fold", F.col("auc").alias("score"))
    rows = cut(rows.select(*map(c, dict.fromkeys([label, fold, *base, *order]))))
    out = []
    for n, d, ms in zip(names, designs, models):
        for v, m in zip(fold_values, ms):
            out.append((n, str(v), auc(score(m, rows.where(c(fold) == F.lit(v)), d), label, "pred").first()["auc"]))
    return df.sparkSession.createDataFrame(out, "feature string, fold string, score double")


def improving_features(scores: DataFrame) -> DataFrame:
    """Features that beat ``base`` on every fold, with their mean score."""
    base = scores.where("feature = 'base'").select("fold", F.col("score").alias("_b"))
    j = scores.where("feature <> 'base'").join(base, "fold")
    per = j.groupBy("feature").agg(F.min((F.col("score") > F.col("_b")).cast("int")).alias("_all"), F.avg("score").alias("cv_score"))
    return per.where("_all = 1").drop("_all")


def dependence_points(df: DataFrame, col: str, max_point: int = 20, rounding: int | None = None) -> DataFrame:
    """Data points of one column for partial dependence: (value, n).

    Few distinct values: each with its count. Many: medians of ``max_point - 10``
    equal-frequency bins with bin counts, plus ten percentiles of the distinct
    values without a count. The null point comes last when there are nulls.
    """
    src = df.select(c(col).cast("double").alias("v"))
    per = running_totals(src, "v", {"n": F.count(F.lit(1))})
    distinct = per.limit(max_point + 1).count()
    nulls = src.where("v is null").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(None).cast("double").alias("value"), "n")
    if distinct <= max_point:
        return per.select(F.col("v").alias("value"), "n").unionByName(nulls)
    from .encoders import quantile_bins

    binned = quantile_bins(src.where("v is not null"), "v", max_point - 10, "b")
    med = exact_quantiles(binned, "v", [0.5], ["b"]).select("b", F.col("quantile").alias("value"))
    cnt = binned.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    probs = [0.05 + 0.1 * i for i in range(10)]
    pct = plotting_quantiles(per.select("v"), "v", probs)
    if rounding is not None:
        pct = pct.withColumn("value", F.bround("value", rounding))
    pct = pct.select("value", F.lit(None).cast("long").alias("n"))
    return med.join(cnt, "b").select("value", "n").unionByName(pct).unionByName(nulls)


def plotting_quantiles(df: DataFrame, col: str, probs: Sequence[float], a: float = 0.4, b: float = 0.4) -> DataFrame:
    """Quantiles at plotting positions ``a + p(1-a-b)`` between neighbouring order statistics."""
    n = df.where(c(col).isNotNull()).count()
    spots = []
    for p in probs:
        aleph = n * p + a + p * (1 - a - b)
        k = int(min(max(aleph, 1), n - 1))
        g = min(max(aleph - k, 0.0), 1.0)
        spots.append((p, (k - 1 + g) / (n - 1)))
    q = exact_quantiles(df, col, [s for _, s in spots])
    return q.select(F.col("quantile").alias("value"))


def partial_dependence(model, df: DataFrame, cols: Sequence[str], target: str, points: Sequence[float], key: str, share: float | None = None) -> DataFrame:
    """Mean prediction with ``target`` fixed at each of a short list of points (None: missing), over all rows.

    ``share`` scores a hashed part of the rows instead.
    """
    base = df if share is None else df.where(hash_unit(key, 3) < share)
    arr = F.array(*[F.lit(None if p is None else float(p)).cast("double") for p in points])
    x = base.withColumn(target, F.explode(arr))
    return score(model, x, cols).groupBy(F.col(target).alias("value")).agg(F.avg("pred").alias("xray"), F.count(F.lit(1)).alias("n_rows"))


def dependence_profile(model, df: DataFrame, cols: Sequence[str], target: str, key: str, max_point: int = 20, rounding: int | None = None) -> DataFrame:
    """Partial dependence of a column at its own data points: (value, n, xray, n_rows).

    ``n`` counts the rows a point stands for (NULL for percentiles); the point of
    missing values is scored like any other. There are at most ``max_point`` points and that one.
    """
    points = dependence_points(df, target, max_point, rounding).collect()
    schema = "point double, n long"
    counts = df.sparkSession.createDataFrame([(r["value"], r["n"]) for r in points], schema)
    x = partial_dependence(model, df, cols, target, sorted({r["value"] for r in points}, key=lambda v: (v is None, v)), key)
    same = F.col("value").eqNullSafe(F.col("point"))
    return x.join(F.broadcast(counts), same).select("value", "n", "xray", "n_rows")


# -- calendar forecast ---------------------------------------------------------------------


def calendar_forecast(daily: DataFrame, date: str, value: str, horizon: int = 0) -> DataFrame:
    """Linear trend plus weekday effect: (date, observed, trend, yhat, residual).

    ``horizon`` adds days after the last one, with NULL where nothing was observed.
    """
    x = daily.select(c(date).cast("date").alias("ds"), c(value).cast("double").alias("observed"))
    fit = x.agg(
        F.struct(
            F.regr_slope("observed", day_number("ds")).alias("b"),
            F.regr_intercept("observed", day_number("ds")).alias("a"),
            F.max("ds").alias("last"),
        ).alias("s")
    )
    if horizon:
        ahead = fit.select(F.explode(F.sequence(F.date_add("s.last", 1), F.date_add("s.last", horizon))).alias("ds"))
        full = x.unionByName(ahead.withColumn("observed", F.lit(None).cast("double")))
    else:
        full = x
    y = full.withColumn("_s", fit.scalar())
    y = y.withColumn("trend", F.col("_s.a") + F.col("_s.b") * day_number("ds")).drop("_s").withColumn("dow", F.weekday("ds"))
    effect = y.where("observed is not null").groupBy("dow").agg(F.avg(F.col("observed") - F.col("trend")).alias("_e"))
    y = y.join(effect, "dow", "left").withColumn("yhat", F.col("trend") + F.coalesce("_e", F.lit(0.0)))
    return y.select("ds", "dow", "observed", "trend", "yhat", (F.col("observed") - F.col("yhat")).alias("residual"))

