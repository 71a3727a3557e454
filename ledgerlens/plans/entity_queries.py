"""Entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import composite_key
from ..functions.scalars import registration_date
from ..operators import chains as ch
from ..operators import entity as en
from ..operators import neighbours as nb
from ..sources.tables import TXN_AGED_SQL, TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import R, query, r, rs

_KEYSETS = {
    "by_segment": ["product", "segment"],
    "by_segment_nation": ["product", "segment", "nation"],
    "by_all": ["product", "segment", "nation", "status"],
}


@query(
    "g01_block_ids", "G01",
    f"""WITH {TXN_WIDE_SQL} SELECT txn_id, """
    + ", ".join(f"min(txn_id) OVER (PARTITION BY {', '.join(ks)}) AS {n}" for n, ks in _KEYSETS.items())
    + " FROM txn_wide",
)
def _(t: Tables):
    d = t.txn_wide.select("txn_id", "product", "segment", "nation", "status")
    return en.block_ids(d, "txn_id", _KEYSETS).select("txn_id", *_KEYSETS)


G02_SQL = f"""x AS (SELECT event_id, user_id, ts, (k % 3)::INT AS d3 FROM ({"SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"})),
  l AS (SELECT *, {', '.join(f"lag(event_id, {i}) OVER w AS i{i}, date_diff('day', (lag(ts, {i}) OVER w)::DATE, ts::DATE) AS g{i}" for i in (1, 2, 3))}
    FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  links AS (SELECT event_id, CASE WHEN g3 = d3 THEN i3 WHEN g2 = d3 THEN i2 WHEN g1 = d3 THEN i1 ELSE event_id END AS parent FROM l)"""


def _gap_links(t):
    d = t.ev.select("event_id", "user_id", "ts", (F.col("k") % 3).cast("int").alias("d3"))
    return en.lagged_gap_links(d, ["user_id"], "event_id", "ts", "d3", 3)


@query("g02_lagged_gap_links", "G02", f"WITH {G02_SQL} SELECT event_id, parent FROM links")
def _(t):
    return _gap_links(t)


@query(
    "g02_linked_entities", "G02 G05",
    f"""WITH RECURSIVE {G02_SQL}, up AS (SELECT event_id, event_id AS root FROM links WHERE parent = event_id
        UNION ALL SELECT c.event_id, up.root FROM links c JOIN up ON c.parent = up.event_id AND c.parent <> c.event_id)
      SELECT event_id, root FROM up""",
)
def _(t):
    return en.forest_roots(_gap_links(t), "event_id")


# The time between the parts, as the chain linker takes it.
QUIET = ("1999-10-01", "2000-06-01")


def _chain_input(t):
    return t.txn_aged.select(
        "txn_id", "uid", "product", "ts", "d1", "split",
        F.when(F.col("txn_id") % 4 > 0, (F.col("txn_id") % 40) * 30).alias("d3"),
        (F.col("txn_id") % 5 + 1).alias("c1"), (F.col("txn_id") % 7 + 1).alias("c13"),
        (F.col("txn_id") % 3).alias("v221"), (F.col("txn_id") % 2).alias("v285"),
        F.date_add(registration_date("ts", "d1"), (F.col("txn_id") % 3 + F.col("txn_id") % 10 % 4).cast("int")).alias("registered"),
    )


def _chain_sql():
    tol = ch.Tolerance()
    near = f"abs(x.n1 - c.n1) <= {tol.counter} AND abs(x.n2 - c.n2) <= {tol.counter}"
    large = f"c.n1 >= {tol.large} AND x.n1 >= {tol.large} AND abs(x.n1 / c.n1) BETWEEN {tol.ratio_low} AND {tol.ratio_high}"
    same = lambda v: f"(abs(x.{v} - c.{v}) <= {tol.value} OR abs(x.{v} - c.{v}) > {tol.value_missing})"
    jump = lambda v: f"abs(x.{v} - c.{v}) BETWEEN {tol.value_gap_low} AND {tol.value_gap_high}"
    border = f"(x.part <> c.part AND c.ts - to_days(x.gap::INT) BETWEEN TIMESTAMP '{QUIET[0]}' AND TIMESTAMP '{QUIET[1]}')"
    match = f"""abs(x.reg - c.reg) <= {tol.registration_days} AND CASE WHEN c.gap IS NULL OR x.gap IS NULL
        THEN (({near}) OR ({large})) AND {same('v1')} AND {same('v2')}
        ELSE (abs(x.age - c.age - x.gap) <= {tol.gap_days} OR {border}) AND abs(x.n1 - c.n1) <= {tol.counter_limit} AND abs(x.n2 - c.n2) <= {tol.counter_limit}
          AND NOT {jump('v1')} AND NOT {jump('v2')}
          AND (({near} AND (abs(x.v1 - c.v1) <= {tol.value} OR abs(x.v2 - c.v2) <= {tol.value}) AND x.age >= c.age) OR ({large} AND x.age <> c.age)) END"""
    latest = ", ".join(f"'{k}': x.{k}" for k in ("ts", *ch.STATE))
    opened = f"{{'name': x.txn_id, 'reg': x.reg, 'part': x.part, {latest}}}"
    moved = f"{{'name': c.name, 'reg': c.reg, 'part': c.part, {latest}}}"
    return f"""WITH RECURSIVE {TXN_AGED_SQL}, x AS (SELECT txn_id, uid, ts, split AS part, row_number() OVER (PARTITION BY uid ORDER BY ts, txn_id) AS i,
        date_diff('day', DATE '1970-01-01', ts::DATE) - d1 + txn_id % 3 + txn_id % 10 % 4 AS reg, d1::DOUBLE AS age,
        (CASE WHEN txn_id % 4 > 0 THEN (txn_id % 40) * 30 END)::DOUBLE AS gap, (txn_id % 5 + 1)::DOUBLE AS n1, (txn_id % 7 + 1)::DOUBLE AS n2,
        (txn_id % 3)::DOUBLE AS v1, (txn_id % 2)::DOUBLE AS v2 FROM txn_aged),
      st AS (SELECT uid, i, txn_id, txn_id AS chain, [{opened}] AS open FROM x WHERE i = 1
        UNION ALL
        SELECT uid, i, txn_id, CASE WHEN hit > 0 THEN open[hit].name ELSE txn_id END,
          CASE WHEN hit > 0 THEN list_transform(open, lambda c, k: CASE WHEN k = hit THEN {moved} ELSE c END) ELSE list_append(open, {opened}) END
        FROM (SELECT x.*, st.open, coalesce(list_position(list_transform(st.open, lambda c: coalesce({match}, false)), true), 0) AS hit
          FROM st JOIN x ON x.uid = st.uid AND x.i = st.i + 1) x)
      SELECT txn_id, chain FROM st"""


@query("g03_greedy_chains", "G03", _chain_sql())
def _(t):
    state = dict(zip(ch.STATE, ["d1", "d3", "c1", "c13", "v221", "v285"]))
    return ch.greedy_chains(_chain_input(t), ["uid"], "txn_id", "ts", state, registered="registered", part="split", quiet=QUIET)


@query(
    "g04_progress_components", "G04 G05",
    f"""WITH RECURSIVE {TXN_AGED_SQL}, x AS (SELECT txn_id, product, epoch_us(ts) AS t, ts::DATE - d1::INT AS reg, d1, (txn_id % 90)::INT AS d3, txn_id % 240 AS d8 FROM txn_aged),
      p AS (SELECT a.txn_id AS x, b.txn_id AS y FROM x a JOIN x b ON a.product = b.product AND trunc((b.t - a.t) / 3600000000.0) = b.d8 - a.d8
        UNION SELECT min(a.txn_id) OVER (PARTITION BY b.txn_id), a.txn_id
          FROM x b JOIN x a ON a.product = b.product AND a.reg = b.reg AND (a.d1 = b.d1 - b.d3 OR a.txn_id = b.txn_id) AND a.d3 <> 0),
      e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
      cc AS (SELECT txn_id AS id, txn_id AS label FROM x UNION SELECT e.y, cc.label FROM cc JOIN e ON e.x = cc.id)
      SELECT id AS txn_id, min(label) AS component FROM cc GROUP BY 1""",
)
def _(t):
    d = t.txn_aged.select(
        "txn_id", "product", "ts", F.date_sub(F.col("ts").cast("date"), F.col("d1")).alias("reg"), "d1",
        (F.col("txn_id") % 90).cast("int").alias("d3"), (F.col("txn_id") % 240).alias("d8"),
    )
    a = en.hour_counter_edges(d, ["product"], "txn_id", "ts", "d8")
    b = en.progress_edges(d, "txn_id", ["product", "reg"], "d1", "d3")
    return en.components(d.select("txn_id"), a.unionByName(b), "txn_id")


@query(
    "g05_consecutive_ids", "G05",
    """WITH c AS (SELECT p_partkey, min(p_partkey) OVER w AS component, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_size, p_type)),
       o AS (SELECT component, row_number() OVER (ORDER BY (n = 1)::INT, component) - 1 AS entity_id FROM (SELECT DISTINCT component, n FROM c))
       SELECT p_partkey, component, entity_id FROM c JOIN o USING (component)""",
)
def _(t):
    d = t.part
    edges = en.invariant_groups(d, ["p_brand", "p_size", "p_type"], "p_partkey").select(F.col("p_partkey").alias("a"), F.col("head").alias("b"))
    comp = en.components(d.select("p_partkey"), edges, "p_partkey")
    return en.consecutive_ids(comp, "p_partkey", "component")


def _jump_sql():
    c1, age, gap = "c1", "d1", "d3"
    lad = lambda steps: " ".join(f"WHEN {c1} <= {b} THEN {v}" for b, v in steps)
    same = f"WHEN {c1} IN (1, 2, 3) THEN {c1}"
    return f"""coalesce(CASE WHEN {age} <= 30 AND {gap} <= 2 THEN CASE {same} {lad(en.JUMP_STEPS_FRESH)} END END,
      CASE WHEN {age} > 30 THEN CASE {same} {lad(en.JUMP_STEPS_OLD)} WHEN {c1} > 40 THEN 2.0 END END,
      CASE WHEN {gap} >= 3 THEN CASE {same} {lad(en.JUMP_STEPS_GAP)} END END, 2.0)"""


def _jump_input(t):
    return t.txn_aged.select(
        "txn_id", "uid", "ts", "d1", (F.col("txn_id") % 9).alias("d3"), (F.col("txn_id") % 53 + 1).cast("double").alias("c1"),
        (F.col("txn_id") % 17 + 1).cast("double").alias("c13"),
    ).withColumn("limit", en.jump_threshold("c1", "d1", "d3"))


@query(
    "g06_split_on_jumps_once", "G06 W17",
    f"""WITH {TXN_AGED_SQL}, x AS (SELECT txn_id, uid, ts, d1, txn_id % 9 AS d3, (txn_id % 53 + 1)::DOUBLE AS c1, (txn_id % 17 + 1)::DOUBLE AS c13 FROM txn_aged),
      y AS (SELECT *, ({_jump_sql()})::DOUBLE AS lim, coalesce(lag(c1) OVER w, c1) AS p1, coalesce(lag(c13) OVER w, c13) AS p13 FROM x WINDOW w AS (PARTITION BY uid ORDER BY ts, txn_id))
      SELECT txn_id, {R('lim')} AS lim, uid || '-' || (c1 / p1 > lim)::INT || '-' || (c13 / p13 > lim)::INT AS split_id FROM y""",
)
def _(t):
    x = en.split_on_jumps(_jump_input(t), "uid", ["ts", "txn_id"], ["c1", "c13"], "limit", rounds=1)
    return x.select("txn_id", r("limit").alias("lim"), "split_id")


def _rounds_sql(n):
    """One table per round: each appends its two flags to the id."""
    parts = []
    for i in range(n):
        prev = "CASE WHEN lag({0}) OVER w IS NULL THEN {0} ELSE lag({0}) OVER w END"
        flags = " || ".join(f"'-' || ({v} / abs({prev.format(v)}) > lim)::INT" for v in ("c1", "c13"))
        parts.append(
            f"r{i + 1} AS (SELECT txn_id, ts, c1, c13, lim, split_id || {flags} AS split_id FROM r{i} WINDOW w AS (PARTITION BY split_id ORDER BY ts, txn_id))"
        )
    return ", ".join(parts)


@query(
    "g06_split_on_jumps", "G06",
    f"""WITH {TXN_AGED_SQL}, x AS (SELECT txn_id, uid, ts, d1, txn_id % 9 AS d3, (txn_id % 53 + 1)::DOUBLE AS c1, (txn_id % 17 + 1)::DOUBLE AS c13 FROM txn_aged),
      r0 AS (SELECT *, ({_jump_sql()})::DOUBLE AS lim, uid::VARCHAR AS split_id FROM x), {_rounds_sql(10)}
      SELECT txn_id, split_id FROM r10""",
)
def _(t):
    x = en.split_on_jumps(_jump_input(t), "uid", ["ts", "txn_id"], ["c1", "c13"], "limit", rounds=10)
    return x.select("txn_id", "split_id")


@query(
    "g07_label_consistency", "G07",
    f"""WITH {TXN_SQL} SELECT txn_id, (max(label) OVER w)::DOUBLE AS max_label, coalesce((label <> max(label) OVER w)::INT, 0) AS disagrees FROM txn
        WINDOW w AS (PARTITION BY uid)""",
)
def _(t):
    d = t.txn.select("txn_id", "uid", "label")
    x = en.label_consistency(d, "uid", "label")
    return x.select("txn_id", F.col("max_label").cast("double").alias("max_label"), "disagrees")


@query(
    "g08_grouping_ids", "G08",
    f"""WITH {TXN_AGED_SQL}, x AS (SELECT *, (ts::DATE - d1::INT) AS reg FROM txn_aged)
      SELECT txn_id, (round_even(amt / (d1 + 1), 3))::DECIMAL(38,3)::VARCHAR || '_' || product AS ugr_ratio,
        strftime(reg, '%Y-%m-%d') || '_' || uid AS ugr_regist FROM x""",
)
def _(t):
    d = t.txn_aged
    return d.select(
        "txn_id", en.grouping_id([en.rounded_text(F.col("amt") / (F.col("d1") + 1), 3), "product"]).alias("ugr_ratio"),
        composite_key([registration_date("ts", "d1"), "uid"]).alias("ugr_regist"),
    )


@query(
    "g09_duplicate_rows", "G09",
    r"""SELECT md5(concat_ws(chr(31), l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_quantity::INT)) AS fingerprint, count(*) AS size, min(l_partkey) AS first_id
       FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def _(t):
    d = t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))
    return en.duplicate_groups(d, "l_partkey", ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "q"])


@query(
    "g10_knn_regression", "G10",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
      d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id)
      SELECT vec_id, count(*)::INT AS n_near, {R('avg(label)')} AS knn_mean FROM d WHERE rn <= 25 GROUP BY 1""",
)
def _(t):
    e = t.embeddings
    return rs(nb.knn_mean(e, e, "vec_id", "embedding", "label", k=25, pivots=16, exclude_self=True), ["knn_mean"])


@query(
    "g10_knn_regression_scaled", "G10",
    f"""WITH s AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS sd FROM embeddings, range(1, 65) g(i) GROUP BY i),
      e AS (SELECT vec_id, label, list((embedding[i]::DOUBLE - m) / sd ORDER BY i) AS v FROM embeddings, s GROUP BY vec_id, label),
      d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id)
      SELECT vec_id, count(*)::INT AS n_near, {R('avg(label)')} AS knn_mean FROM d WHERE rn <= 350 GROUP BY 1""",
)
def _(t):
    e = nb.scale_vectors(t.embeddings, "embedding", "z", 64)
    return rs(nb.knn_mean(e, e, "vec_id", "z", "label", k=350, pivots=16, exclude_self=True), ["knn_mean"])


_LEAK_A, _LEAK_B = "amt / (amt + 200000)", "(txn_id * 37 % 101) / 101.0"


@query(
    "g11_leak_split", "G11",
    f"""WITH {TXN_SQL}, m AS (SELECT product, uid FROM txn GROUP BY ALL HAVING count(DISTINCT month) > 1)
      SELECT txn_id, (EXISTS (SELECT 1 FROM m WHERE m.uid = t.uid AND m.product = t.product) OR abs({_LEAK_A} - {_LEAK_B}) > 0.4)::INT AS is_leak FROM txn t""",
)
def _(t):
    d = t.txn.select(
        "txn_id", composite_key(["uid", "product"]).alias("entity"), "month", F.expr("amt / (amt + 200000D)").alias("a"),
        ((F.col("txn_id") * 37 % 101) / 101.0).alias("b"),
    )
    return en.leak_split(d, "entity", "month", "a", "b", 0.4).select("txn_id", "is_leak")
