"""Matches, linked sets and chains without pairs, against plain answers; hubs and crowded cells spread over tasks."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dominance, entity

HOUR = 3_600_000_000


def plain_totals(rows):
    out = {}
    for point, g, x, y, low, high, i in rows:
        below = [r for r in rows if r[1] == g and r[2] < x and r[3] < y and r[4]]
        above = [r for r in rows if r[1] == g and r[2] > x and r[3] > y and r[5]]
        out[point] = (sum(r[4] for r in below), min((r[6] for r in below), default=None), sum(r[5] for r in above), min((r[6] for r in above), default=None))
    return out


def merged(df):
    out = {}
    for r in df.collect():
        n1, i1, n2, i2 = out.get(r.point, (0, None, 0, None))
        i1 = min([x for x in (i1, r.below_id if r.below_n else None) if x is not None], default=None)
        i2 = min([x for x in (i2, r.above_id if r.above_n else None) if x is not None], default=None)
        out[r.point] = (n1 + r.below_n, i1, n2 + r.above_n, i2)
    return out


def some_points(rng, n, groups, span):
    points = []
    for k in range(n):
        g, x = rng.randrange(groups), rng.randrange(span)
        points.append((k, g, x, rng.randrange(span), rng.choice([0, 1, 3]), rng.choice([0, 2]), rng.randrange(1000) - 500))
    return points


@pytest.mark.parametrize("span", [6, 40, 10_000])
def test_sweep_against_pairs(span):
    rng = random.Random(span)
    for n in (1, 2, 3, 17, 120):
        rows = some_points(rng, n, 3, span)
        p = pd.DataFrame(rows, columns=["point", "g", "x", "y", "low", "high", "id"])
        got = dominance.sweep(*(p[k].to_numpy() for k in ("g", "x", "y")), -p["x"].to_numpy(), *(p[k].to_numpy() for k in ("low", "high", "id")))
        want = plain_totals(rows)
        for k in range(n):
            a, b, c, d = (got[f][k] for f in ("below_n", "below_id", "above_n", "above_id"))
            assert (a, b if a else None, c, d if c else None) == want[k]


def test_totals_in_strips(spark):
    rows = some_points(random.Random(2), 600, 2, 5000) + [(1000 + k, 7, k, -k % 5, 1, 1, k) for k in range(40)]
    df = spark.createDataFrame(rows, "point long, g int, x long, y long, low long, high long, id long")
    want = plain_totals(rows)
    assert merged(dominance.dominance_totals(df, ["g"])) == want
    assert merged(dominance.dominance_totals(df, ["g"], rows_per_split=60)) == want


def test_crowded_cell_is_not_paired():
    """100,000 points of one cell in one task; pairs would be ten thousand million."""
    rng = np.random.default_rng(1)
    n = 100_000
    start = time.process_time()
    got = dominance.sweep(np.zeros(n, int), rng.permutation(n), rng.permutation(n), np.zeros(n, int), np.ones(n, int), np.ones(n, int), np.arange(n))
    assert time.process_time() - start < 20
    assert got["below_n"].sum() == got["above_n"].sum() > n * n // 5


def matches(rows):
    found = {}
    for i, g, t, k in rows:
        found[i] = [j for j, h, u, m in rows if h == g and int((u - t) / HOUR) == m - k]
    return found


def event_rows(rng, n, whole_hours=False):
    step = HOUR if whole_hours else HOUR // 4
    return [(i, rng.choice("ab"), rng.randrange(-20, 30) * step + rng.choice([0, 0, 1, step // 2]) * (not whole_hours), rng.randrange(4)) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, us long, k long")
    return df.withColumn("t", F.timestamp_micros("us").cast("timestamp_ntz"))


def plain_sets(ids, pairs):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


@pytest.mark.parametrize("whole_hours", [False, True])
def test_hour_counters_against_pairs(spark, whole_hours):
    rows = event_rows(random.Random(5), 150, whole_hours)
    df, want = frame(spark, rows), matches(rows)
    for kw in ({}, {"rows_per_split": 20}):
        got = {r.id: (r.head, r.size) for r in entity.hour_counter_partners(df, ["g"], "id", "t", "k", **kw).collect()}
        assert got == {i: (min(js), len(js)) for i, js in want.items()}
        edges = entity.hour_counter_edges(df, ["g"], "id", "t", "k", **kw)
        sets = plain_sets(want, [(r.a, r.b) for r in edges.collect()])
        assert sets == plain_sets(want, [(i, j) for i, js in want.items() for j in js])
        assert edges.count() <= 4 * len(rows)


def test_rising_links_leave_out_lonely_points(spark):
    rng = random.Random(6)
    for n in (1, 8, 60):
        rows = [(i, rng.randrange(3), i, *rng.choice([(rng.randrange(30), None), (None, rng.randrange(30)), (y := rng.randrange(30), y)])) for i in range(n)]
        pairs = [(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[2] < q[2] and p[3] is not None and q[4] is not None and p[3] < q[4]]
        df = spark.createDataFrame(rows, "id long, g int, x long, low long, high long")
        for kw in ({}, {"rows_per_split": 5}):
            links = [(r.a, r.b) for r in entity.rising_links(df, ["g"], "id", "x", "low", "high", **kw).collect()]
            ids = [r[0] for r in rows]
            assert plain_sets(ids, links) == plain_sets(ids, pairs)


@pytest.mark.parametrize("split", [0, 1 << 30])
def test_components_of_hubs_paths_and_loops(spark, split):
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component for r in entity.components(spark.range(420), df, "id", rows_per_split=split).collect()}
    assert got == plain_sets(range(420), pairs)
    assert entity.components(spark.range(0), df.limit(0), "id").count() == 0


def largest_share(spark, df, key):
    """Largest share of the rows that one task of a shuffle by the plan gets."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_a_star_of_100000_leaves(spark):
    n = 100_000
    edges = spark.range(1, n + 1, 1, 64).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hub = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        assert largest_share(spark, entity._least_around(hub, hub, True), "a") < 1 / 20
        got = entity.components(spark.range(n + 5), edges, "id", rows_per_split=1000).groupBy("component").count().collect()
        assert sorted((r["component"], r["count"]) for r in got) == [(0, n + 1), *((n + k, 1) for k in range(1, 5))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_path_of_10000_nodes(spark):
    n = 10_000
    order = list(range(n))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = entity.components(spark.range(n), edges, "id")
    assert got.where("component = 0").count() == n


@pytest.mark.parametrize("limit", [50, 10**6])
def test_rising_links_add_up_what_is_to_come_once(spark, limit):
    """No frame that ends with the group, which starts anew for every row: 3,000 points of one group, with repeats, against plain loops."""
    rnd = random.Random(8)
    data = [(i // 2, rnd.randint(0, 10**6), rnd.choice([None, rnd.randint(0, 50)]), rnd.choice([None, rnd.randint(0, 50) - i // 60])) for i in range(3000)]
    data = sorted({(x, i): (1, i, x, lo, hi) for i, x, lo, hi in data}.values(), key=lambda p: (p[2], p[1]))
    points = spark.createDataFrame(data, "g int, id long, x long, low long, high long")
    got = entity.rising_links(points, ["g"], "id", "x", "low", "high", rows_per_split=limit)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert limit == 50 or "unboundedfollowing" not in plan.lower()
    none = float("inf")
    least, most = [none], [-none]
    for p in data:
        least.append(min(least[-1], none if p[3] is None else p[3]))
    for p in reversed(data):
        most.append(max(most[-1], -none if p[4] is None else p[4]))
    most = most[::-1]
    want, last = [], None
    for n, (_, i, _, lo, hi) in enumerate(data):
        if (lo is not None and lo < most[n + 1]) or (hi is not None and hi > least[n]):
            if last is not None and least[n] < most[n] and last != i:
                want.append((i, last))
            last = i
    assert sorted(map(tuple, got.collect())) == sorted(want)
