"""The paths for hot keys and many buckets give the same answers as the plain ones."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.attach import attach, group_size
from ledgerlens.operators import chains, entity, metrics, neighbours, ordering, quality, sampling, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """1500 rows: key 0 holds two thirds, times repeat, some keys are missing."""
    rnd = random.Random(5)
    data = [
        (i, 0 if rnd.random() < 0.66 else rnd.choice([1, 2, 3, None]), rnd.randint(0, 4000), rnd.choice([None, *range(50)]))
        for i in range(1500)
    ]
    df = spark.createDataFrame(data, "id long, key long, sec long, v long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("sec") * 600).cast("timestamp_ntz")).drop("sec").cache()


@pytest.mark.parametrize("limit", [3, 40, 10**6])
def test_sliced_lags_equal_plain_window(hot, limit):
    exprs = {f"p{i}": (lambda w, i=i: F.lag("id", i).over(w)) for i in range(1, 6)}
    exprs |= {f"m{i}": (lambda w, i=i: F.lead("id", i).over(w)) for i in range(1, 6)}
    got = windows.ordered(hot, ["key"], ["ts", "id"], exprs, 5, 5, rows_per_split=limit)
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = hot.where("key IS NOT NULL").withColumns({k: f(w) for k, f in exprs.items()})
    assert rows(got.where("key IS NOT NULL"), "id", *exprs) == rows(want, "id", *exprs)
    assert got.count() == hot.count()


def test_slices_hold_rows_however_close_their_times(spark):
    """A burst within one second, rows without a time and one late row."""
    df = spark.range(6000).select(
        "id", F.lit(1).alias("key"),
        F.when(F.col("id") >= 1000, F.when(F.col("id") == 5999, F.lit("2030-01-01")).otherwise("2024-01-01")).cast("timestamp_ntz").alias("ts"),
    )
    parts, any_hot = windows.sliced(df, ["key"], ["ts", "id"], 500)
    sizes = [r["count"] for r in parts.groupBy("_slice").count().collect()]
    assert any_hot and sum(sizes) == 6000 and len(sizes) > 12 and max(sizes) <= 1000
    edges = parts.groupBy("_slice").agg(F.min(F.struct("ts", "id")).alias("lo"), F.max(F.struct("ts", "id")).alias("hi")).orderBy("_slice").collect()
    assert all(a.hi.id < b.lo.id for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("limit", [7, 10**6])
def test_sliced_row_numbers(hot, limit):
    got = windows.row_numbers(hot, ["key"], ["ts", "id"], rows_per_split=limit)
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = hot.where("key IS NOT NULL").withColumn("row_no", F.row_number().over(w))
    assert rows(got, "id", "row_no") == rows(want, "id", "row_no")


@pytest.mark.parametrize("limit", [5, 60])
def test_running_totals_over_buckets(hot, limit):
    m = {"n": F.count(F.lit(1)), "s": F.sum("id")}
    assert len(ordering.value_edges(hot, "v", limit)) > 3
    for by in ([], ["key"]):
        got = ordering.running_totals(hot, "v", m, by, rows_per_bucket=limit)
        want = ordering.running_totals(hot, "v", m, by)
        cols = [*by, "v", "n", "n_before", "s", "s_before"]
        assert rows(got, *cols) == rows(want, *cols)


def test_quantiles_over_buckets_match_numpy(hot):
    v = np.array([r[0] for r in hot.where("v IS NOT NULL").select("v").collect()], dtype=float)
    for probs in ([0.1, 0.5, 0.93], [i / 20 for i in range(21)], [i / 50 for i in range(50)]):
        got = ordering.quantile_list(hot, "v", probs, rows_per_bucket=20)
        assert np.allclose(got, np.quantile(v, probs))


def test_ranks_over_buckets(hot):
    got = ordering.ranked(hot, "v", {"r": "average"}, rows_per_bucket=11).select("id", "v", "r").toPandas()
    want = got["v"].rank(method="average")
    assert np.allclose(got["r"], want, equal_nan=True)


def test_auc_over_buckets_and_symmetry(hot):
    x = hot.where("v IS NOT NULL").withColumn("y", (F.col("id") % 3 == 0).cast("int")).withColumn("neg", -F.col("v"))
    a = metrics.auc(x, "y", "v", rows_per_bucket=9).first()["auc"]
    p = x.select("y", "v").toPandas()
    pos, neg = p[p.y == 1].v.to_numpy()[:, None], p[p.y == 0].v.to_numpy()
    assert a == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())
    assert metrics.auc(x, "y", "neg").first()["auc"] == pytest.approx(1 - a)


def test_ks_over_buckets(hot):
    x = hot.where("v IS NOT NULL").withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    a = quality.ks_two_sample(x, "split", ["v"], rows_per_bucket=9).first()
    b = quality.ks_two_sample(x, "split", ["v"]).first()
    assert a["ks"] == pytest.approx(b["ks"])


def test_hour_counts_with_ties(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("ab"), rnd.choice([0, 600, 1800, 3599]) + 3600 * rnd.randint(0, 30)) for _ in range(120)]
    df = spark.createDataFrame(data, "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = windows.window_hours(df, ["key"], "ts", [2, -2, -1])
    for r in got.collect():
        mine = [s for k, s in data if k == r["key"]]
        top = max(s for s in mine if s // 3600 == r["hour_no"])
        assert r["hour2_count"] == sum(top - 7200 <= s <= top for s in mine)
        assert r["hourm2_count"] == sum(top <= s <= top + 7200 for s in mine)
        assert r["hourm1_count"] == sum(top <= s <= top + 3600 for s in mine)


def _may_follow(first, last, row, quiet):
    """The rules for one chain and one row, spelled out; rows are dicts, ``first`` opened the chain, ``last`` is its latest row."""
    if first["reg"] is not None and row["reg"] is not None and abs(first["reg"] - row["reg"]) > 1:
        return False
    steps = {k: abs(row[k] - last[k]) for k in ("n1", "n2", "v1", "v2")}
    little = steps["n1"] <= 1 and steps["n2"] <= 1
    big = last["n1"] >= 3 and row["n1"] >= 3 and 0.8 <= row["n1"] / last["n1"] <= 1.2
    if last["gap"] is None or row["gap"] is None:
        return (little or big) and all(steps[v] <= 1 or steps[v] > 90000 for v in ("v1", "v2"))
    older = row["age"] - last["age"]
    if abs(older - row["gap"]) > 1:
        said = last["s"] - row["gap"] * 86400
        if first["part"] == row["part"] or quiet is None or not quiet[0] <= said <= quiet[1]:
            return False
    if steps["n1"] > 1000 or steps["n2"] > 1000 or any(10 <= steps[v] <= 100 for v in ("v1", "v2")):
        return False
    return little and min(steps["v1"], steps["v2"]) <= 1 and older >= 0 or big and older != 0


def _literal_greedy(block, quiet):
    """Two nested passes: a base scans forward, moves to every match; what is left starts over."""
    block = sorted(block, key=lambda r: (r["s"], r["id"]))
    chain = {}
    while len(chain) < len(block):
        left = [r for r in block if r["id"] not in chain]
        first = last = left[0]
        chain[first["id"]] = first["id"]
        for row in left[1:]:
            if _may_follow(first, last, row, quiet):
                chain[row["id"]] = first["id"]
                last = row
    return chain


@pytest.mark.parametrize("limit", [10**6, 12])
@pytest.mark.parametrize("n", [160, 700])
def test_greedy_chains_equal_literal_definition(spark, limit, n):
    """``limit`` cuts blocks into slices; with 700 rows, blocks are longer than those that advance together."""
    rnd = random.Random(9)
    rows, blocks = [], {}
    quiet = (30 * 86400, 32 * 86400)
    for i in range(n):
        age = rnd.randint(0, 60)
        r = {"id": i, "key": rnd.choice([0, 0, 0, 1, 2, 3]), "s": age * 86400 + rnd.randint(0, 9), "age": age, "gap": rnd.choice([None, 0, 1, 2, 5, 10])}
        r |= {"n1": rnd.randint(1, 6), "n2": rnd.randint(1, 4), "v1": rnd.choice([0, 1, 2, 30]), "v2": rnd.choice([0, 1, 99999]), "part": "a" if age < 31 else "b"}
        r["reg"] = rnd.choice([7, 7, 8, 9, 15, 16, 40]) if r["key"] != 2 or rnd.random() < 0.7 else None
        rows.append(r)
        blocks.setdefault(r["key"], []).append(r)
    schema = "id long, key long, s long, age long, gap long, n1 long, n2 long, v1 long, v2 long, part string, reg int"
    df = spark.createDataFrame([tuple(r[k] for k in ("id", "key", "s", "age", "gap", "n1", "n2", "v1", "v2", "part", "reg")) for r in rows], schema)
    df = df.withColumns({"ts": F.timestamp_seconds("s"), "day": F.date_from_unix_date("reg")})
    named = dict(registered="day", part="part", quiet=("1970-01-31", "1970-02-02"))
    got = chains.greedy_chains(df, ["key"], "id", "ts", {s: s for s in chains.STATE}, rows_per_split=limit, **named)
    want, without, no_border = {}, {}, {}
    for b in blocks.values():
        want |= _literal_greedy(b, quiet)
        no_border |= _literal_greedy(b, None)
        without |= _literal_greedy([r | {"reg": None} for r in b], None)
    assert {r["id"]: r["chain"] for r in got.collect()} == want
    assert len(set(want.values())) < len(want) and want != no_border and no_border != without
    if limit > n:
        plain = chains.greedy_chains(df, ["key"], "id", "ts", {s: s for s in chains.STATE})
        assert {r["id"]: r["chain"] for r in plain.collect()} == without


def test_open_chains_are_looked_up(monkeypatch):
    """A row of a long block meets chains of its registration days and of the age it asks for, not all open ones."""
    seen = []
    plain = chains.matches
    monkeypatch.setattr(chains, "matches", lambda tails, *rest: seen.append(len(tails)) or plain(tails, *rest))
    rnd = random.Random(3)
    open_ = chains.OpenChains(np.zeros(0, "int64"), np.zeros((0, 7)), np.zeros((0, 2)), chains.Tolerance(), None)
    for i in range(2000):
        row = [i // 10, rnd.randint(100, 150), rnd.randint(1, 9), 1, 50 * rnd.randint(0, 9), 0, i]
        open_.add(i, np.array(row, dtype=float), np.array([rnd.randint(0, 60), 0], dtype=float))
    assert open_.n > 1500 and np.mean(seen) < open_.n / 50


def test_components_of_known_shapes(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200, 201), (201, 202), (202, 200)]
    edges = spark.createDataFrame(chain + star + ring, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 130), 200, 201, 202, 999]], "id long")
    got = {r["id"]: r["component"] for r in entity.components(nodes, edges, "id").collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200, 999: 999}
    assert got == want


def test_forest_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(100)] + [(500, 500)], "id long, parent long")
    got = {r["id"]: r["root"] for r in entity.forest_roots(links, "id").collect()}
    assert got == {i: 0 for i in range(100)} | {500: 500}


def test_split_on_jumps_equals_pandas(spark):
    rnd = random.Random(4)
    data = [(i, i % 5, i, float(rnd.randint(1, 30)), float(rnd.randint(1, 9)), 1.5) for i in range(120)]
    df = spark.createDataFrame(data, "id long, e long, t long, a double, b double, lim double")
    got = entity.split_on_jumps(df, "e", ["t", "id"], ["a", "b"], "lim", rounds=4).select("id", "split_id").toPandas()
    p = pd.DataFrame(data, columns=["id", "e", "t", "a", "b", "lim"])
    p["g"] = p["e"].astype(str)
    for _ in range(4):
        f = [(p[v] / p.groupby("g")[v].shift(1).fillna(p[v]).abs() > p["lim"]).astype(int).astype(str) for v in "ab"]
        p["g"] = p["g"] + "-" + f[0] + "-" + f[1]
    assert dict(zip(got["id"], got["split_id"])) == dict(zip(p["id"], p["g"]))


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.1, (150, 3)), rng.normal(4, 1, (60, 3))])
    data = [(i, [float(x) for x in v], float(i % 7)) for i, v in enumerate(pts)]
    df = spark.createDataFrame(data, "id long, vec array<double>, y double")
    got = neighbours.knn_mean(df, df, "id", "vec", "y", k=9, pivots=6, exclude_self=True, block_rows=25)
    got = {r["id"]: (r["n_near"], r["knn_mean"]) for r in got.collect()}
    d = np.sqrt(((pts[:, None] - pts) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        near = np.lexsort((np.arange(len(pts)), d[i]))[:9]
        assert got[i] == (9, pytest.approx(np.mean([data[j][2] for j in near])))


@pytest.mark.parametrize("batch", [7, 10000])
def test_knn_blocks_read_points_batch_by_batch(spark, monkeypatch, batch):
    # whole numbers, so that many distances are equal; no cell can be left out, and a row has no target
    rng = np.random.default_rng(8)
    pts = rng.integers(0, 3, (240, 12)).astype(float)
    pts[200:] = pts[:40]
    data = [(i, [float(x) for x in v], None if i == 5 else float(i % 7)) for i, v in enumerate(pts)]
    df = spark.createDataFrame(data, "id long, vec array<double>, y double")
    monkeypatch.setattr(neighbours, "AT_ONCE", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = neighbours.knn_mean(df, df, "id", "vec", "y", k=9, pivots=4, exclude_self=True, block_rows=25)
        assert "CoGroups" not in out._jdf.queryExecution().toString()
        got = {r["id"]: (r["n_near"], r["knn_mean"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    d = np.sqrt(((pts[:, None] - pts) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        near = np.lexsort((np.arange(len(pts)), d[i]))[:9]
        assert got[i] == (9, None if 5 in near else pytest.approx(np.mean([data[j][2] for j in near])))


def test_knn_merges_ids_only_if_they_repeat(spark):
    rng = np.random.default_rng(21)
    pts = rng.normal(0, 1, (300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], 1.0) for i, v in enumerate(pts)], "id long, vec array<double>, y double")
    out = neighbours.knn_mean(df, df, "id", "vec", "y", k=5, pivots=4, exclude_self=True, block_rows=20)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert out.count() == 300


@pytest.mark.parametrize("met", [1 << 6, 1 << 21])
def test_knn_with_repeated_ids_and_vectors(spark, monkeypatch, met):
    # ids that come twice with other vectors, one vector in a third of the rows, large shared offsets, a row with NaN
    rng = np.random.default_rng(22)
    pts = rng.normal(1000, 1, (240, 5))
    pts[::3] = pts[0]
    ids = [f"i{x:03d}" for x in [*range(200), *range(40)]]
    pts[7, 2] = np.nan
    df = spark.createDataFrame([(i, [float(x) for x in v], float(n % 11)) for n, (i, v) in enumerate(zip(ids, pts))], "id string, vec array<double>, y double")
    monkeypatch.setattr(neighbours, "MET", met)
    monkeypatch.setattr(neighbours, "SORTED", 500)
    monkeypatch.setattr(neighbours, "PACK", 16)
    got = neighbours.knn_mean(df, df, "id", "vec", "y", k=6, pivots=3, exclude_self=True, block_rows=30)
    got = {r["id"]: (r["n_near"], r["knn_mean"]) for r in got.collect()}
    d = np.sqrt(((pts[:, None] - pts) ** 2).sum(-1))
    for x in set(ids) - {"i007"}:
        # the best of all rows of the id
        met_by = sorted((d[a, b], ids[b], b % 11) for a in range(240) if ids[a] == x for b in range(240) if ids[b] != x and np.isfinite(d[a, b]))
        per = [sorted((d[a, b], ids[b], b % 11) for b in range(240) if ids[b] != x and np.isfinite(d[a, b]))[:6] for a in range(240) if ids[a] == x]
        want = sorted(sum(per, []))[:6]
        assert want == met_by[:6] and got[x][0] == 6
        if len({w[:2] for w in sorted(sum(per, []))[:7]}) == 7:
            assert got[x][1] == pytest.approx(np.mean([w[2] for w in want]))


def test_knn_block_keeps_the_best_as_points_pass(monkeypatch):
    monkeypatch.setattr(neighbours, "SORTED", 300)
    monkeypatch.setattr(neighbours, "AT_ONCE", 1000)
    rng = np.random.default_rng(23)
    pts = np.round(rng.normal(0, 1, (3000, 6)), 1)
    ids, y = pa.array(range(3000)), pa.array(rng.random(3000))
    block = neighbours._Block(ids.slice(0, 90), pts[:90], 4, True)
    for lo in range(0, 3000, 250):
        block.meet(ids.slice(lo, 250), pts[lo : lo + 250], y.slice(lo, 250))
    assert len(block.near) <= 90 * 4 + 300 + 250
    kind = pa.schema([("_id", pa.int64()), ("_b", pa.list_(pa.struct([("dist", pa.float64()), ("near_id", pa.int64()), ("target", pa.float64())])))])
    got = [r for b in block.result(kind, 32) for r in b.to_pylist()]
    d = np.zeros((90, 3000))
    for x in range(6):
        d += (pts[:90, None, x] - pts[:, x]) ** 2
    d = np.sqrt(d)
    for i, r in enumerate(got):
        d[i, i] = np.inf
        near = np.lexsort((np.arange(3000), d[i]))[:4]
        assert r["_id"] == i and [(e["dist"], e["near_id"]) for e in r["_b"]] == [(d[i, j], j) for j in near]
    assert len(got) == 90


def test_stratified_folds_are_balanced(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    n = sampling.stratified_folds(df, "id", "y", 4).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in n if r["y"] == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("hot_keys", [2, 10, 2000])
@pytest.mark.parametrize("null_safe", [False, True])
def test_attach_serves_hot_and_cold_keys(hot, hot_keys, null_safe):
    src = hot if null_safe else hot.where("key IS NOT NULL")
    stats = src.groupBy("key").agg(F.sum("id").alias("s"), F.max("v").alias("m"), group_size())
    got = attach(hot, stats, ["key"], null_safe=null_safe, hot_keys=hot_keys)
    assert got.columns == [*hot.columns, "s", "m"]
    want = {}
    for i, k, v in [(r["id"], r["key"], r["v"]) for r in hot.collect()]:
        s, m = want.get(k, (0, None))
        want[k] = (s + i, v if m is None else max(m, v) if v is not None else m)
    if not null_safe:
        want[None] = (None, None)
    assert got.count() == hot.count()
    assert all((r["s"], r["m"]) == want[r["key"]] for r in got.collect())


def test_attach_few_falls_back_when_the_table_is_long(hot, monkeypatch):
    import ledgerlens.operators.attach as mod

    stats = hot.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), group_size())
    a = rows(attach(hot, stats, ["key"], few=True), "id", "n")
    monkeypatch.setattr(mod, "FEW", 1)
    assert rows(attach(hot, stats, ["key"], few=True), "id", "n") == a


def test_rows_without_a_time_stay_first_in_a_hot_key(spark):
    data = [(i, 0, None if i % 10 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(data, "id long, key long, t long")
    got = windows.ordered(df, ["key"], ["t", "id"], {"p": lambda w: F.lag("id", 1).over(w)}, 1, 0, rows_per_split=7)
    want = df.withColumn("p", F.lag("id", 1).over(Window.partitionBy("key").orderBy("t", "id")))
    assert rows(got, "id", "p") == rows(want, "id", "p")
