"""Hand-made frames: missing keys, zero divisors, one-row groups, empty and odd values."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import lookups, rowwise, safe, scalars
from ledgerlens.operators import aggs, encoders, entity, filters, metrics, models, newton, quality, sampling, target, topics, udf, windows
from ledgerlens.session import cut, scratch
from ledgerlens.sources import store, warehouse


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def unit(spark):
    return spark.range(1)


def test_ratio_by_zero_is_null(unit):
    assert one(unit, safe.ratio(F.lit(3), F.lit(0))) is None
    assert one(unit, safe.ratio(F.lit(3), F.lit(1), 1)) == 1.5


def test_composite_key_shows_missing_parts(unit):
    assert one(unit, safe.composite_key([F.lit("a"), F.lit(None), F.lit(7)])) == "a_#_7"


def test_size_pair_with_missing_parts(spark):
    df = spark.createDataFrame([("1920x1080",), ("800",), (None,), ("axb",)], "s string")
    w, h = scalars.size_pair("s")
    assert [tuple(r) for r in df.select(w, h).collect()] == [(1920.0, 1080.0), (800.0, None), (None, None), (None, None)]


def test_domain_without_dot(spark):
    df = spark.createDataFrame([("gmail",), ("mail.yahoo.co.uk",), (None,)], "d string")
    got = df.select(scalars.domain_prefix("d"), scalars.domain_suffix("d")).collect()
    assert [tuple(r) for r in got] == [("gmail", "us"), ("mail", "uk"), ("#", "nan")]


def test_split_part_beyond_end(unit):
    assert one(unit, scalars.part(F.lit("name"), "/", 1)) is None


def test_half_even_rounding(unit):
    assert one(unit, scalars.round_even(F.lit(2.5))) == 2.0
    assert one(unit, scalars.round_even(F.lit(3.5))) == 4.0


@pytest.mark.parametrize("value,top,low,want", [(123.0, 500.0, 1.0, 0), (12.0, 15.0, 10.0, 2), (12.34, 15.0, 1.0, 1), (1.2345, 2.0, 1.0, 3), (1.2, 2.0, 1.0, 2)])
def test_round_digits(unit, value, top, low, want):
    assert one(unit, scalars.round_digits(F.lit(value), F.lit(top), F.lit(low))) == want


def test_registration_date_without_age(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 3, 5, 9), 4.0), (dt.datetime(2018, 3, 5, 9), None)], "ts timestamp, d double")
    got = [r[0] for r in df.select(scalars.registration_date("ts", "d")).collect()]
    assert got == [dt.date(2018, 3, 1), dt.date(2018, 3, 5)]


def test_new_year_on_saturday_is_observed_in_december(spark):
    df = spark.createDataFrame([(dt.date(2021, 12, 31),), (dt.date(2022, 1, 1),), (dt.date(2018, 11, 22),)], "d date")
    assert [r[0] for r in df.select(scalars.is_us_holiday("d")).collect()] == [1, 0, 1]


def test_os_versions_without_dots(spark):
    rows = [("mac", "10.12.6"), ("mac", "1012"), ("ios", "1121"), ("windows", "vista sp1"), ("android", "711"), ("linux", "4"), ("windows", "0")]
    df = spark.createDataFrame(rows, "o string, v string")
    got = [str(r[0]) for r in df.select(lookups.os_release_date("o", "v")).collect()]
    assert got == ["2017-07-19", "2016-09-20", "2017-12-13", "2007-01-30", "2016-12-05", "None", "None"]


def test_later_device_rules_see_earlier_results(spark):
    df = spark.createDataFrame([("sm-g930",), ("moto g",), ("hi6210",), ("fridge",), (None,)], "d string")
    assert [r[0] for r in df.select(lookups.device_name("d")).collect()] == ["samsung", "motorola", "huawei", "fridge", None]


def test_block_stats_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(*rowwise.block_stats(["a", "b", "c"], "x")).collect()]
    assert got[0] == (2.5, 5.0, pytest.approx(2.1213203), 4.0, 4.0)
    assert got[1] == (None, 0.0, None, None, 1.0)
    assert got[2] == (2.0, 2.0, None, 2.0, 2.0)


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(rowwise.clip("v", 0.0, 4.0)).collect()] == [4.0, None, 0.0]


def test_group_stats_small_groups_and_missing_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", 2.0), ("c", 2.0), ("c", 2.0), (None, 9.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in aggs.group_stats(df, ["k"], {"v": ["std", "skew"]}).collect()}
    assert got == {"a": (None, None), "b": (pytest.approx(2**0.5), None), "c": (0.0, 0.0)}
    out = aggs.attach(df, aggs.group_stats(df, ["k"], {"v": ["mean"]}), ["k"])
    assert out.count() == df.count()


def test_count_encoding_counts_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, k string")
    assert {r["id"]: r["n"] for r in aggs.counts(df, ["k"]).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r["id"]: r["cnt__k"] for r in aggs.sentinel_count(df, "k").collect()} == {1: 1, 2: 2, 3: 2}


def test_mode_prefers_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (9,), (None,)], "v int")
    assert sorted(r["v"] for r in aggs.mode_fill(df, "v").collect()) == [1, 1, 1, 3, 3, 9]


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert quality.constant_columns(df, ["v"]).first()["is_constant"] == 0
    assert filters.null_shares(df, ["v"]).first()["null_share"] == 1.0
    assert filters.drop_sparse_columns(df).columns == ["id"]


def test_audit_nan_and_infinite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    r = quality.audit(df, ["v"]).first()
    assert (r["nulls"], r["infs"], r["max_value"], r["min_value"]) == (2, 1, float("inf"), 1.0)


def test_replace_infinite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (inf,), (-inf,), (7.0,)], "v double")
    assert [r["v"] for r in scalars.replace_inf(df, ["v"]).collect()] == [1.0, 7.0, 1.0, 7.0]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("x", 0, 0.5), ("y", 1, 0.1), ("z", 1, 0.9), ("z", 0, 0.1)], "s string, y int, p double")
    assert {r["s"]: r["auc"] for r in metrics.auc(df, "y", "p", ["s"]).collect()} == {"x": 0.5, "y": None, "z": 1.0}


def test_ks_equal_and_disjoint(spark):
    same = [("train", 1.0), ("test", 1.0), ("train", 2.0), ("test", 2.0)]
    apart = [("train", float(i)) for i in range(50)] + [("test", float(i + 100)) for i in range(50)]
    for rows, ks, keep in ((same, 0.0, 1), (apart, 1.0, 0)):
        r = quality.ks_two_sample(spark.createDataFrame(rows, "split string, v double"), "split", ["v"]).first()
        assert (r["ks"], r["keep"]) == (ks, keep)


def test_leave_period_out_never_reads_its_own_period(spark):
    rows = [(i, "ab"[i % 2], i % 3, i % 2) for i in range(12)] + [(99, "a", 5, None), (98, "zz", 0, 1)]
    df = spark.createDataFrame(rows, "id int, k string, m int, y int")
    flipped = df.withColumn("y", F.when(F.col("m") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    enc = lambda d: {r["id"]: r["te"] for r in target.leave_period_out(d, ["k"], "y", "m", "te").collect()}
    a, b = enc(df), enc(flipped)
    assert len(a) == len(rows)
    assert all(a[r[0]] == b[r[0]] for r in rows if r[2] == 1)
    assert a[98] is None  # its only period is its own
    assert a[99] == pytest.approx(0.0)


def test_smoothed_mean_of_unseen_key_is_the_prior(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("new", None)], "k string, y int")
    got = {r["k"]: r["te"] for r in target.smoothed_label_mean(df, "k", "y", "te", 1, 1).collect()}
    assert got["new"] == pytest.approx(2 / 3)


def test_proximity_weights(unit):
    w = lambda own, other: one(unit, target.proximity_weight(F.lit(own).cast("int"), F.lit(other), 6))
    assert [round(w(2, p), 2) for p in (0, 1, 3, 4, 5)] == [0.8, 1.0, 0.6, 0.4, 0.2]
    assert [round(w(None, p), 2) for p in range(6)] == [0.25, 0.4, 0.55, 0.7, 0.85, 1.0]


def test_trailing_window_has_both_ends_and_needs_activity(spark):
    days = [(0, 1.0), (3, 5.0), (4, 2.0), (20, 8.0)]
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), v) for d, v in days]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = [r["day3_v_sum"] for r in windows.window_days(df, ["k"], "ts", "v", [3], ["sum"]).orderBy("_day").collect()]
    assert got == [1.0, 6.0, 7.0, 8.0]


def test_next_period_must_be_adjacent(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4)], "k string, m int")
    got = {r["m"]: r["x"] for r in windows.next_period_ratio(df, ["k"], "m", "x").collect()}
    assert got == {1: 1.0, 2: 0.0, 4: 0.0}


def test_mask_values_seen_in_one_split(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "train"), (4, None, "test")], "id int, v string, split string")
    assert {r["id"]: r["v"] for r in filters.mask_unshared(df, "v", "split").collect()} == {1: "a", 2: "a", 3: None, 4: None}
    assert {r["id"]: r["f"] for r in filters.in_other_split(df, "v", "split", "f").collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_factorize_and_one_hot_with_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, v string")
    assert {r["id"]: r["v"] for r in encoders.factorize(df, ["v"]).collect()} == {1: 1, 2: -1, 3: 0}
    assert {r["id"]: (r["v_a_dummie"], r["v_b_dummie"]) for r in encoders.one_hot(df, ["v"]).collect()} == {1: (0, 1), 2: (0, 0), 3: (1, 0)}


def test_one_hot_refuses_unbounded_columns(spark):
    with pytest.raises(ValueError):
        encoders.one_hot(spark.range(50).selectExpr("cast(id as string) v"), ["v"], limit=10)


@pytest.mark.parametrize("sizes", [[1] * 50, [30, 1, 1, 1, 1, 1, 1, 1, 1, 1], [9, 7, 7, 7, 4, 4, 3, 3, 3, 3, 2, 1, 1], [5], [100, 60, 2, 2, 2, 2]])
def test_group_folds_join_the_lightest_fold(spark, sizes):
    rows = [(f"g{i:03d}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)]
    got = {r["g"]: r["fold"] for r in sampling.group_folds(spark.createDataFrame(rows, "g string"), "g", 3).distinct().collect()}
    load, want = [0, 0, 0], {None: None}
    for n, i in sorted(((n, i) for i, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        f = load.index(min(load))
        load[f] += n
        want[f"g{i:03d}"] = f
    assert got == want


def test_hour_counter_partners_across_an_hour_edge(spark):
    """Whole hours apart are cut towards zero, so 00:50 and 02:10 are one hour apart and 01:10 and 00:50 none."""
    times = ["2024-01-01 00:50:00", "2024-01-01 02:10:00", "2024-01-01 01:10:00", "2024-01-01 00:50:00"]
    counters = [5, 6, 5, 9]
    df = spark.createDataFrame([(i, "a", t, k) for i, (t, k) in enumerate(zip(times, counters))], "id int, g string, t string, k int")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r["id"]: (r["head"], r["size"]) for r in entity.hour_counter_partners(df, ["g"], "id", "t", "k").collect()}
    # 0-1: 1 h 20 min and counters 1 apart. 0-2: 20 min and 0 apart. 1-2: -1 h and -1. 3 stands alone.
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1)}


def test_progress_links_skip_candidates_without_a_step(spark):
    rows = [(1, "a", 3, 3), (2, "a", 3, 0), (3, "a", 8, 5), (4, "a", 8, 0), (5, "a", 8, 0), (6, "a", 8, 2), (7, "b", 8, 0), (8, "b", 8, 1)]
    df = spark.createDataFrame(rows, "id int, g string, d1 int, d3 int")
    got = {r["id"]: (r["matches"], r["partner"], r["set_size"]) for r in entity.progress_links(df, "id", ["g"], "d1", "d3").collect()}
    # Row 3 asks for day 3, where row 1 has a step. Row 2 asks for day 3 as well, but has no step: row 1 alone is no set.
    # Rows 4 and 5 ask for day 8, where rows 3 and 6 have steps; row 7 finds row 8 alone.
    assert got == {3: (1, 1, 2), 4: (2, 3, 2), 5: (2, 3, 2)}
    edges = entity.progress_edges(df, "id", ["g"], "d1", "d3")
    sets = {r["id"]: r["component"] for r in entity.components(df.select("id"), edges, "id").collect()}
    assert sets == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 1, 7: 7, 8: 8}


def test_covered_columns_chain(spark):
    """Of a chain where only neighbours correlate, the dropped middle drops nobody."""
    rows = [(float(i), float(i + (i % 3)), float(i + (i % 3) + 3 * (i % 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    at = sorted(r["corr"] for r in quality.correlation_pairs(df, ["a", "b", "c"]).collect())
    assert quality.covered_columns(df, ["a", "b", "c"], (at[0] + at[1]) / 2) == ["b"]


def test_duplicates_separate_null_from_text(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "b")], "id int, x string, y string")
    assert [(r["size"], r["first_id"]) for r in entity.duplicate_groups(df, "id", ["x", "y"]).collect()] == [(2, 1)]


def test_weight_grid_contains_equal_weights():
    grid = metrics.weight_grid(2, 0.1)
    assert (0.5, 0.5) in grid and len(grid) == 9


def test_improving_features_need_every_fold(spark):
    rows = [("base", "1", 0.7), ("base", "2", 0.7), ("a", "1", 0.8), ("a", "2", 0.75), ("b", "1", 0.9), ("b", "2", 0.6)]
    got = models.improving_features(spark.createDataFrame(rows, "feature string, fold string, score double")).collect()
    assert [r["feature"] for r in got] == ["a"]


def test_feature_table_is_written_once(spark):
    path = scratch(spark, "once")
    df = spark.createDataFrame([(1, "train", 2.0), (2, "test", 3.0)], "id int, split string, v double")
    store.save_features(df, "id", "f", path, ["v"])
    store.save_features(df.withColumn("v", F.lit(0.0)), "id", "f", path, ["v"])
    assert sorted(r["f__v"] for r in spark.read.parquet(path).collect()) == [2.0, 3.0]


def test_delete_keeps_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert {r["v"] for r in warehouse.without_values(df, "v", ["a"]).collect()} == {"b", None}


def test_correlations_of_500_columns_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 500)) + 1e6
    x[:, 100:200] = x[:, :100] + rng.normal(scale=0.1, size=(300, 100))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.25
    x[:, 8] = np.nan
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = quality.correlation_pairs(df, names).toPandas()
    assert len(got) == 500 * 499 // 2 and not got.duplicated(["col_a", "col_b"]).any()
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    a, b = (got[k].str[1:].astype(int).to_numpy() for k in ("col_a", "col_b"))
    assert (a < b).all()
    r = got["corr"].to_numpy(dtype=float)
    assert np.isnan(r[(a == 7) | (b == 7) | (a == 8) | (b == 8)]).all()
    assert np.nanmax(np.abs(r - want[a, b])) < 1e-6
    few = quality.correlation_pairs(df.limit(0), names[:3])
    assert few.count() == 0 or few.where("corr IS NOT NULL").count() == 0


def test_a_delete_that_fails_leaves_the_table(spark, monkeypatch):
    place = scratch(spark, "versions")
    w = warehouse.Warehouse(spark, "lens_versions", place)
    try:
        w.create_as("t", spark.range(10).withColumn("v", F.when(F.col("id") > 2, F.col("id") % 3)))
        old = w.place("t")

        def stop(self, table, path):
            raise RuntimeError("lost between write and switch")

        with monkeypatch.context() as m:
            m.setattr(warehouse.Warehouse, "_switch", stop)
            with pytest.raises(RuntimeError):
                w.delete("t", "v", [1])
        assert w.place("t") == old and w.table("t").count() == 10
        w.delete("t", "v", [1, 1, 99])
        assert w.place("t") != old and sorted(r["id"] for r in w.table("t").collect()) == [0, 1, 2, 3, 5, 6, 8, 9]
        w.insert("t", spark.range(20, 22))
        w.delete("t", "id", spark.createDataFrame([(0,), (20,), (None,)], "id long"))
        assert sorted(r["id"] for r in w.table("t").collect()) == [1, 2, 3, 5, 6, 8, 9, 21]
        w.delete("t", "id", [])
        assert w.table("t").count() == 8
    finally:
        w.drop()


def test_group_aggregate_merges_no_more_than_the_fan_in(spark):
    """One key in 10,000 partial rows, and one that is missing."""
    df = spark.range(0, 10_000, 1, 16).select(F.when(F.col("id") < 9_990, F.lit(1)).alias("k"), "id")

    def lift(g):
        return pd.DataFrame({"k": g["k"].array, "n": 1, "s": g["id"].array, "most": 0})

    def merge(g):
        most = max(len(g) if len(g) > 1 else 0, int(g["most"].max()))
        return pd.DataFrame({"k": g["k"].array[:1], "n": [g["n"].sum()], "s": [g["s"].sum()], "most": [most]})

    schema = "k int, n long, s long, most long"
    got = {r.k: r for r in udf.grouped_aggregate(df, ["k"], lift, merge, lambda g: g, schema, schema, fan_in=50).collect()}
    assert got[1].n == 9_990 and got[1].s == sum(range(9_990)) and got[1].most <= 50
    assert got[None].n == 10 and got[None].s == sum(range(9_990, 10_000))


def _toy(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) * [3.0, 200.0] + [10.0, -5000.0]
    y = (x[:, 0] + x[:, 1] / 100 + rng.normal(scale=3, size=n) > -40).astype(float)
    rows = [(i, float(a), float(b) if i % 7 else None, float(t) if i % 10 else None, i % 3) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, fold int")


def test_newton_fits_meet_the_gradient_condition(spark):
    """At the fitted coefficients the weighted slopes of all rows but the held-out fold add up to nothing."""
    df = _toy(spark).withColumn("w", 1.0 + F.col("id") % 2)
    p = df.where("y IS NOT NULL").na.fill({"b": -1.0}).toPandas()
    got = newton.fit_many(df, "y", [["a"], ["a", "b"], []], fold="fold", held=[0, 2], weight="w")
    for cols, models in zip((["a"], ["a", "b"], []), got):
        for held, m in zip((0, 2), models):
            q = p[p["fold"] != held]
            z = m.intercept + q[cols].to_numpy() @ np.array(m.coefficients)
            slope = (q["y"] - 1 / (1 + np.exp(-z))) * q["w"]
            assert abs(slope.sum()) < 1e-6
            assert all(abs((slope * (q[c] - q[c].mean())).sum()) < 1e-4 for c in cols)
    line = newton.fit_many(df, "a", [["b"]], logistic=False)[0][0]
    full = _toy(spark).na.fill({"b": -1.0}).toPandas()
    slope, intercept = np.polyfit(full["b"], full["a"], 1)
    assert line.coefficients[0] == pytest.approx(slope) and line.intercept == pytest.approx(intercept)


def test_newton_steps_survive_separated_and_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i > 5)) for i in range(12)], "x double, one double, y double")
    m = newton.fit_one(df, "y", ["x", "one"])
    scores = [r["p"] for r in df.select("y", m.score().alias("p")).orderBy("x").collect()]
    assert scores == sorted(scores) and scores[5] < 0.5 < scores[6] and all(0 <= s <= 1 for s in scores)
    assert newton.fit_one(df.limit(0), "y", ["x"]).coefficients == (0.0,)


def test_cross_validation_reads_the_rows_once_a_step(spark):
    df = _toy(spark)
    pred, imp = models.cross_validate(df, "id", "y", ["a", "b"], "fold", [0, 1])
    got = {r["id"]: r["pred"] for r in pred.collect()}
    fits = newton.fit_many(df, "y", [["a", "b"]], fold="fold", held=[0, 1])[0]
    both = df.select("id", "y", "fold", fits[0].score().alias("p0"), fits[1].score().alias("p1")).collect()
    for r in both:
        want = (r.p0 + r.p1) / 2 if r.y is None else {0: r.p0, 1: r.p1}.get(r.fold)
        assert got.get(r.id) == (pytest.approx(want) if want is not None else None)
    assert [r["feature"] for r in imp.collect()] == ["a", "b"]
    trees, _ = models.cross_validate(df, "id", "y", ["a", "b"], "fold", [0, 1], "lgb", {"maxIter": 2})
    assert trees.count() == len(got)
    table = {(r["feature"], r["fold"]): r["score"] for r in models.candidate_scores(df, "y", ["a"], ["b"], "fold", [0, 1]).collect()}
    assert set(table) == {(f, v) for f in ("base", "b") for v in "01"} and all(0.5 < s <= 1 for s in table.values())


@pytest.mark.parametrize("few", [3, 1000])
def test_best_blend_by_bounds_equals_all_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(metrics, "FEW_VECTORS", few)
    monkeypatch.setattr(metrics, "VECTORS", 20)
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    rows = [(float(t), *map(float, np.round(rng.random(3) * 0.7 + t * 0.1 * np.arange(3), 3))) for t in y]
    df = spark.createDataFrame(rows + [(None, 0.1, 0.2, 0.3)], "y double, a double, b double, c double")
    want = metrics.best_blend(metrics.blend_search(df, "y", ["a", "b", "c"], 0.1), ["a", "b", "c"]).first()
    got = metrics.find_best_blend(df, "y", ["a", "b", "c"], 0.1, buckets=16).first()
    assert tuple(got)[:3] == tuple(want)[:3] and got["auc"] == pytest.approx(want["auc"])
    exact = {tuple(r)[:3]: r["auc"] for r in metrics.blend_search(df, "y", ["a", "b", "c"], 0.1).collect()}
    cells = metrics._score_cells(df, "y", ["a", "b", "c"])
    bounds = metrics._auc_bounds(cells, "y", ["a", "b", "c"], list(exact), 0.0, 1.0, 32)
    assert all(low - 1e-9 <= exact[w] <= high + 1e-9 for w, (low, high) in zip(exact, bounds))


def test_grouped_aggregate_lifts_a_key_once_a_slice(spark, tmp_path):
    rows = [(i % 60, float(i % 5)) for i in range(3000)] + [(None, 1.0)] * 40 + [(7, 2.0)] * 1000
    df = spark.createDataFrame(rows, "k long, v double").repartition(8, "v", F.rand(1))
    seen = str(tmp_path)

    def lift(g):
        with open(f"{seen}/lifts", "a") as f:
            f.write("x")
        return pd.DataFrame({"k": [g["k"].iloc[0]], "n": [len(g)]})

    def merge(g):
        return pd.DataFrame({"k": [g["k"].iloc[0]], "n": [g["n"].sum()]})

    out = udf.grouped_aggregate(df, ["k"], lift, merge, lambda g: g, "k long, n long", "k long, n long", **({"slice_rows": 300} if hasattr(udf, "SLICE_ROWS") else {}))
    assert {r.k: r.n for r in out.collect()} == {k: 50 for k in range(60) if k != 7} | {None: 40, 7: 1050}
    # 59 keys, the missing one and 4 slices; each of the 8 partitions' keys before
    assert (tmp_path / "lifts").stat().st_size <= 70


def test_best_blend_ranks_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    rows = [(float(t), *map(float, rng.random(3) + t * 0.2 * np.arange(3))) for t in y]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    want = metrics.best_blend(metrics.blend_search(df, "y", ["a", "b", "c"], 0.1), ["a", "b", "c"]).first()
    ranked, exact = [], metrics._exact_aucs
    monkeypatch.setattr(metrics, "_exact_aucs", lambda d, label, models, grid: (ranked.append(len(grid)), exact(d, label, models, grid))[1])
    monkeypatch.setattr(metrics, "RANKED", 400, raising=False)
    got = metrics.find_best_blend(df, "y", ["a", "b", "c"], 0.1, buckets=16).first()
    assert tuple(got)[:3] == tuple(want)[:3] and got["auc"] == pytest.approx(want["auc"])
    # the first 16 buckets leave several of the 36 vectors, finer ones the best
    assert ranked[:-1] == [1]


def test_exact_blend_aucs_in_slices_equal_windows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, 500)
    # ties, halves of the ninth digit, one value in most rows, missing and infinite scores
    a = np.where(rng.random(500) < 0.5, 0.25, np.round(rng.random(500), 2)).tolist()
    b = (rng.integers(0, 40, 500) * 5e-10 + 0.1).tolist()
    a[3], a[4], b[5], b[6] = None, float("nan"), float("inf"), float("-inf")
    df = spark.createDataFrame([(float(t), u, v) for t, u, v in zip(y, a, b)] + [(None, 0.5, 0.5)], "y double, a double, b double")
    cells, grid = metrics._score_cells(df, "y", ["a", "b"]), [(0.3, 0.7), (0.5, 0.5), (0.02, 0.98)]
    monkeypatch.setattr(metrics, "PACK", 64)
    monkeypatch.setattr(metrics, "SLICE", 40)
    got = metrics._exact_aucs(metrics._packed(cells, "y", ["a", "b"]), "y", ["a", "b"], grid).collect()
    want = metrics._window_aucs(cells, "y", ["a", "b"], grid).collect()
    assert {tuple(r)[:2]: r["auc"] for r in got} == {tuple(r)[:2]: pytest.approx(r["auc"], abs=1e-14) for r in want} and len(got) == 3


def test_best_blend_with_scores_that_are_no_numbers(spark):
    rng = np.random.default_rng(13)
    rows = [(float(t), float(rng.random() + t * 0.3), float(rng.random())) for t in rng.integers(0, 2, 300)]
    rows += [(1.0, float("nan"), 0.1), (0.0, float("inf"), 0.2), (0.0, 0.3, float("nan"))]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    want = metrics.best_blend(metrics.blend_search(df, "y", ["a", "b"], 0.05), ["a", "b"]).first()
    got = metrics.find_best_blend(df, "y", ["a", "b"], 0.05, buckets=16).first()
    assert tuple(got)[:2] == tuple(want)[:2] and got["auc"] == pytest.approx(want["auc"])


def test_best_blend_starts_with_buckets_for_its_rows(spark, monkeypatch):
    # labels by chance: 512 buckets rule nothing out, and no vector goes on to windows over all rows
    rng = np.random.default_rng(14)
    rows = [(float(t), *map(float, rng.random(3))) for t in rng.integers(0, 2, 6000)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    want = metrics.best_blend(metrics.blend_search(df, "y", ["a", "b", "c"], 0.1), ["a", "b", "c"]).first()
    windows = []
    monkeypatch.setattr(metrics, "running_totals", lambda *a, f=metrics.running_totals, **kw: (windows.append(1), f(*a, **kw))[1])
    got = metrics.find_best_blend(df, "y", ["a", "b", "c"], 0.1).first()
    assert tuple(got)[:3] == tuple(want)[:3] and got["auc"] == pytest.approx(want["auc"], abs=1e-12) and not windows


@pytest.mark.parametrize("digits", [8, 9, 10, 17])
def test_ninth_digit_rounds_like_spark(spark, digits):
    rng = np.random.default_rng(digits)
    values = [0.0, 5e-10, -5e-10, 1.5e-9, 4194304.1, 9e6 + 1e-9, 1e300, *np.round(rng.normal(0, 10.0 ** rng.integers(-9, 7, 300)), digits).tolist()]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", F.round("v", 9).alias("r")).collect()
    assert metrics._ninth_digit(np.array([r.v for r in rows])).tolist() == [r.r for r in rows]


def test_sharded_table_has_no_task_larger_than_the_scan(spark):
    path = scratch(spark, "shards")
    store.write_shards(spark.range(0, 1000, 1, 12), path, 3)
    got = store.read_shards(spark, f"{path}/part-*.parquet")
    per = got.groupBy(F.input_file_name()).count().collect()
    assert got.count() == 1000 and len(per) == 12 and max(r["count"] for r in per) < 200


def test_weekday_median_by_buckets(spark):
    rows = [("a", float(i % 13)) for i in range(60)] + [("b", 2.0), (None, 5.0), (None, 8.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for kw in ({}, {"rows_per_bucket": 3}):
        got = {r["k"]: r["median"] for r in aggs.weekday_stats(df, ["k"], "v", **kw).collect()}
        assert got == {"a": 5.5, "b": 2.0, None: 6.5, "c": None}


def test_topics_of_two_vocabularies(spark):
    rows = [(i, ["apple", "pear", "plum", "the"] * 3 if i % 2 else ["iron", "zinc", "lead", "the"] * 3) for i in range(20)] + [(98, []), (99, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r["id"]: r for r in models.topic_mixture(df, "id", "tokens", k=2, iterations=6).collect()}
    assert set(got) == set(range(20)) and all(abs(r["topic_0"] + r["topic_1"] - 1) < 1e-9 for r in got.values())
    side = {i % 2: r["topic_0"] > 0.5 for i, r in got.items()}
    assert side[0] != side[1] and all((r["topic_0"] > 0.5) == side[i % 2] for i, r in got.items())
    assert models.topic_mixture(df.limit(0), "id", "tokens", k=2).count() == 0


@pytest.mark.parametrize("at_least, rows_per_id", [(2, 64), (2, 1), (3, 64)])
def test_tokens_seen_once_are_left_out_by_their_place(spark, at_least, rows_per_id):
    """Rows of one id, rows without id or text, tokens at the same place of two rows, white space at both ends."""
    data = [(1, " a b  once "), (1, "b a twin"), (1, "x a"), (2, "twin a"), (2, None), (3, ""), (3, "only"), (None, "a lone b"), (None, "b q q"), (4, "b once-more b")]
    long = [(i, p, t) for i, x in data if x is not None for p, t in enumerate(re.split(r"\s+", x)) if t]
    n = Counter(t for _, _, t in long)
    got = models.tokens_without_singletons(spark.createDataFrame(data, "id long, text string"), "id", "text", at_least, rows_per_id)
    assert got.columns == ["id", "pos", "token"]
    assert Counter(map(tuple, got.collect())) == Counter(r for r in long if n[r[2]] >= at_least)


def test_tokens_seen_once_need_no_exchange_of_tokens(spark):
    docs = spark.range(50).select("id", F.concat_ws(" ", F.lit("a"), "id", F.lit("b")).alias("text"))
    long = models.tokens_without_singletons(docs, "id", "text")
    per = long.groupBy("id").agg(F.count_distinct("token").alias("n"))
    plan = per._jdf.queryExecution().sparkPlan().toString()
    assert "_salt" not in plan and {r["n"] for r in per.collect()} == {2}


def plain_topic_shares(docs, k, iterations, seed):
    """The rounds over all (id, token) pairs at once."""
    n = Counter((i, t) for i, x in docs if i is not None for t in x or () if t is not None)
    start = lambda t, j: 0.5 + int(hashlib.md5(f"{t}:{j}:{seed}".encode()).hexdigest()[:8], 16) / 4294967296
    w = {t: np.array([start(t, j) for j in range(k)]) for _, t in n}
    s = {i: np.full(k, 1 / k) for i, _ in n}
    for _ in range(iterations):
        scale = sum(w.values()) + topics.TOKEN_PRIOR * len(w)
        fit = {(i, t): s[i] * (w[t] + topics.TOKEN_PRIOR) / scale for i, t in n}
        fit = {p: n[p] * x / x.sum() for p, x in fit.items()}
        w, total = {t: np.zeros(k) for t in w}, {i: np.zeros(k) for i in s}
        for (i, t), x in fit.items():
            w[t] += x
            total[i] += x
        s = {i: (x + topics.DOC_PRIOR) / (x.sum() + topics.DOC_PRIOR * k) for i, x in total.items()}
    return s


@pytest.mark.parametrize("k, iterations, block", [(3, 0, 1 << 24), (3, 1, 40), (3, 2, 1 << 24), (2, 5, 40), (1, 3, 40), (4, 4, 1)])
def test_topic_rounds_over_blocks_equal_plain_rounds(spark, k, iterations, block):
    """Several blocks to a task, ids in several rows, missing ids, lists and tokens, and a token 300 times in a document."""
    rnd = random.Random(3)
    docs = [(i % 37 if i % 9 else None, [rnd.choice(["a", "b", "c", f"w{i % 5}", f"x{rnd.randint(0, 30)}", None]) for _ in range(rnd.randint(0, 12))]) for i in range(80)]
    docs += [(100, None), (101, []), (102, [None]), (103, ["often"] * 300 + ["a"])]
    df = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(5)
    got = {r["id"]: r[1:] for r in topics.topic_shares(df, "id", "tokens", k, iterations, 7, block, 25).collect()}
    want = plain_topic_shares(docs, k, iterations, 7)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], rtol=0, atol=1e-10) for i in want)


def test_topic_rounds_shuffle_no_pairs(spark, monkeypatch):
    """What a round puts back together has one row per token and block, and per document, not one per occurrence."""
    held = []
    monkeypatch.setattr(topics, "cut", lambda df: held.append(cut(df)) or held[-1])
    docs = spark.range(2000).select("id", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (i * 7 % 60).cast("string")).alias("tokens"))
    topics.topic_shares(docs, "id", "tokens", 2, 3)
    assert max(x.count() for x in held) == 2050
