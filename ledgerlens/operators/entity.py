"""Entity resolution: blocking ids, links between rows, linked sets, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, composite_key, day_number, epoch_micros, has_all, text
from ..session import cut
from .aggs import multi_period_entities
from .attach import SIZE, attach, group_size
from .dominance import dominance_totals
from .ordering import dense_codes
from .windows import ROWS_PER_SPLIT, hot_table, jump_flags, ordered, sliced


def block_ids(df: DataFrame, id_col: str, keysets: dict[str, Sequence[str]]) -> DataFrame:
    """Per key set the smallest row id that shares the keys; a missing key is a value of its own."""
    out = df
    for name, keys in keysets.items():
        k = df.select(id_col, F.md5(composite_key(keys, sep="\x1f")).alias("_k"))
        per = k.groupBy("_k").agg(F.min(id_col).alias(name), group_size())
        out = attach(out.withColumn("_k", F.md5(composite_key(keys, sep="\x1f"))), per, ["_k"]).drop("_k")
    return out


def label_consistency(df: DataFrame, entity: str, label: str) -> DataFrame:
    """Largest label in the entity and whether the row disagrees with it."""
    per = df.where(has_all([entity])).groupBy(entity).agg(F.max(label).alias("max_label"), group_size())
    j = attach(df, per, [entity])
    return j.withColumn("disagrees", F.coalesce((c(label) != F.col("max_label")).cast("int"), F.lit(0)))


def lagged_gap_links(df: DataFrame, keys: Sequence[str], id_col: str, ts: str, gap: str, reach: int = 3, **kw) -> DataFrame:
    """(id, parent): the farthest of the ``reach`` previous rows of the block whose distance
    in days equals the row's own ``gap``; unlinked rows are their own parent."""
    exprs = {}
    for i in range(1, reach + 1):
        exprs[f"_t{i}"] = lambda w, i=i: F.lag(ts, i).over(w)
        exprs[f"_i{i}"] = lambda w, i=i: F.lag(id_col, i).over(w)
    x = ordered(df, keys, [ts, id_col], exprs, reach, 0, **kw)
    parent = None
    for i in range(reach, 0, -1):
        hit = day_number(ts) - day_number(f"_t{i}") == c(gap)
        parent = F.when(hit, F.col(f"_i{i}")) if parent is None else parent.when(hit, F.col(f"_i{i}"))
    return x.select(id_col, F.coalesce(parent, c(id_col)).alias("parent"))


def forest_roots(links: DataFrame, id_col: str, parent: str = "parent", out: str = "root") -> DataFrame:
    """Root of each row when every row has at most one earlier parent.

    Pointer jumping: each round doubles the distance covered and is checkpointed,
    so the rounds are bounded by the logarithm of the rows; beyond it there is a cycle.
    """
    cur = cut(links.select(id_col, c(parent).alias("_p")))
    for _ in range(cur.count().bit_length() + 2):
        up = cur.select(c(id_col).alias("_p"), F.col("_p").alias("_pp"))
        nxt = cur.join(up, "_p", "left").select(id_col, F.coalesce("_pp", "_p").alias("_p"), (F.coalesce("_pp", "_p") != F.col("_p")).alias("_moved"))
        nxt = cut(nxt)
        moved = not nxt.where("_moved").isEmpty()
        cur = nxt.drop("_moved")
        if not moved:
            return cur.withColumnRenamed("_p", out)
    raise RuntimeError("links did not settle; is there a cycle?")


def _least_around(edges: DataFrame, around: DataFrame, hubs: bool) -> DataFrame:
    """``edges`` with ``_m``, the smallest ``b`` of their ``a`` in ``around``; a hub's edges are dealt out by ``attach``."""
    least = around.groupBy("a").agg(F.min("b").alias("_m"), group_size())
    return attach(edges, least, ["a"]) if hubs else edges.join(least.drop(SIZE), "a")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    x = _least_around(both.where("b > a"), both, hubs)
    return x.select(F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; edges are (larger, smaller)."""
    x = _least_around(edges, edges, hubs)
    return x.select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b")).distinct()


def components(
    nodes: DataFrame, edges: DataFrame, id_col: str, a: str = "a", b: str = "b", out: str = "component", rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Smallest id of each linked set.

    Large-star and small-star steps take turns until the edges stay as they are;
    every node then has one edge, to the smallest of its set. Only nodes with an
    edge take part, the others are their own set. The edges of a hub are added up
    before the shuffle for its minimum, and spread over all tasks when they ask for
    it, once there are more edges than a task can read. Each round is checkpointed.
    """
    ends = edges.select(c(a).alias("_x"), c(b).alias("_y")).where("_x <> _y")
    now = cut(ends.select(F.greatest("_x", "_y").alias("a"), F.least("_x", "_y").alias("b")).distinct())
    state, before = _edge_state(now), None
    while state != before and state[0]:
        hubs = state[0] > rows_per_split
        now = cut(_small_star(_large_star(now, hubs), hubs))
        state, before = _edge_state(now), state
    roots = now.select(F.col("a").alias("_a"), F.col("b").alias("_root"))
    ids = nodes.select(c(id_col).alias("_a"))
    return ids.join(roots, "_a", "left").select(F.col("_a").alias(id_col), F.coalesce("_root", "_a").alias(out))


def _edge_state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def consecutive_ids(sets: DataFrame, id_col: str, component: str, out: str = "entity_id") -> DataFrame:
    """Linked sets get ids 0.. in order of their smallest row; single rows follow after the largest."""
    size = sets.groupBy(component).agg(F.count(F.lit(1)).alias("_n"))
    order = size.select((F.col("_n") == 1).cast("int").alias("_single"), component, F.col("_n").alias(SIZE))
    codes = dense_codes(order, ["_single", component], out).drop("_single")
    return attach(sets, codes, [component]).select(id_col, component, out)


def invariant_groups(df: DataFrame, keys: Sequence[Column | str], id_col: str) -> DataFrame:
    """Rows that agree on all keys form one set: (id, head, size). Equality is
    transitive, so the head and the size stand for all pairs of the set."""
    names = [f"_k{i}" for i in range(len(keys))]
    x = df.select(id_col, *[c(k).alias(n) for k, n in zip(keys, names)]).where(has_all(names))
    per = x.groupBy(*names).agg(F.min(id_col).alias("head"), F.count(F.lit(1)).alias("size"), group_size())
    return attach(x, per, names).select(id_col, "head", "size")


HOUR = 3_600_000_000


def _hour_spots(df: DataFrame, keys: Sequence[str], id_col: str, ts: str, counter: str) -> DataFrame:
    """Rows of the same keys, time and counter as one spot, with the hour cell of its time minus counter."""
    x = df.where(has_all([*keys, ts, counter])).select(id_col, *keys, epoch_micros(ts).alias("_t"), c(counter).cast("long").alias("_k"))
    spots = x.groupBy(*keys, "_t", "_k").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_id"))
    hour = F.floor(F.col("_t") / HOUR).cast("long")
    spots = spots.withColumns({"_hour": hour, "_cell": hour - F.col("_k"), "_off": F.col("_t") - hour * HOUR})
    return cut(spots.withColumn("_spot", F.monotonically_increasing_id()))


def _hour_groups(spots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every spot in the three groups that hold its matches, as a point whose order in x and y decides on a match.

    Two spots match if the hours between them, cut towards zero, are the difference
    of their counters. Hours of the clock and offsets within the hour say the same:
    spots of one cell match if the later one's offset is not smaller (kind 0), and a
    spot matches one of the next cell if it is not later but has the larger offset
    (kinds 1 and 2).
    """
    cell, one = F.col("_cell"), lambda g, kind: F.struct(g.alias("cell"), F.lit(kind).alias("kind"))
    x = spots.withColumn("_in", F.explode(F.array(one(cell, 0), one(cell, 1), one(cell - 1, 2))))
    kind, none = F.col("_in.kind"), F.lit(0).cast("long")
    # Equal offsets of one cell match, so there the hour decides between them.
    y = F.when(kind == 0, F.col("_off") * (1 << 31) + F.col("_hour") + (1 << 30)).otherwise(-F.col("_off"))
    low, high = F.when(kind == 2, none).otherwise(F.col("_n")), F.when(kind == 1, none).otherwise(F.col("_n"))
    point = F.col("_spot") * 3 + kind
    return x.select(*keys, F.col("_in.cell").alias("_cell"), (kind > 0).alias("_pair"), point.alias("point"), "_id", F.col("_t").alias("x"), y.alias("y"), low.alias("low"), high.alias("high"))


def hour_counter_partners(df: DataFrame, keys: Sequence[str], id_col: str, ts: str, counter: str, **kw) -> DataFrame:
    """(id, head, size): the smallest matching row (itself included) and the number of matches, by totals instead of pairs.

    Ids are whole numbers.
    """
    keys = list(keys)
    spots = _hour_spots(df, keys, id_col, ts, counter)
    points = _hour_groups(spots, keys).withColumn("id", c("_id").cast("long")).drop("_id")
    found = dominance_totals(points, [*keys, "_cell", "_pair"], **kw)
    # A spot asks both ways in its own cell, upwards in the pair with the next cell, downwards in the one before.
    kind = F.col("point") % 3
    up, down = F.when(kind == 2, 0).otherwise(F.col("above_n")), F.when(kind == 1, 0).otherwise(F.col("below_n"))
    least = F.least(F.when(up > 0, F.col("above_id")), F.when(down > 0, F.col("below_id")))
    per = found.groupBy(F.floor(F.col("point") / 3).cast("long").alias("_spot")).agg(F.sum(up + down).alias("_more"), F.min(least).alias("_least"))
    per = spots.join(per, "_spot").select(
        *keys, "_t", "_k", F.least(c("_id"), c("_least").cast(dict(spots.dtypes)["_id"])).alias("head"), (F.col("_n") + F.col("_more")).alias("size"), F.col("_n").alias(SIZE)
    )
    rows = df.where(has_all([*keys, ts, counter])).select(id_col, *keys, epoch_micros(ts).alias("_t"), c(counter).cast("long").alias("_k"))
    return attach(rows, per, [*keys, "_t", "_k"]).select(id_col, "head", "size")


def hour_counter_edges(df: DataFrame, keys: Sequence[str], id_col: str, ts: str, counter: str, **kw) -> DataFrame:
    """(a, b) edges that connect exactly the rows the matches connect: at most three per spot, and rows to their spot."""
    keys = list(keys)
    spots = _hour_spots(df, keys, id_col, ts, counter)
    points = _hour_groups(spots, keys).select(*keys, "_cell", "_pair", "_id", "x", F.when(c("low") > 0, c("y")).alias("low"), F.when(c("high") > 0, c("y")).alias("high"))
    links = rising_links(points, [*keys, "_cell", "_pair"], "_id", "x", "low", "high", **kw)
    rows = df.where(has_all([*keys, ts, counter])).select(id_col, *keys, epoch_micros(ts).alias("_t"), c(counter).cast("long").alias("_k"))
    own = spots.select(*keys, "_t", "_k", F.col("_id").alias("b"), F.col("_n").alias(SIZE))
    own = attach(rows, own, [*keys, "_t", "_k"]).select(F.col(id_col).alias("a"), "b").where("a <> b")
    return links.unionByName(own)


def rising_links(points: DataFrame, group: Sequence[str], id_col: str, x: str, low: str, high: str, **kw) -> DataFrame:
    """(a, b) edges that connect what "earlier and lower" connects: an earlier point's ``low`` below a later one's ``high``.

    In order of ``x`` the linked sets of a group are stretches, once points that are
    linked to none are left out: two neighbours are in one set if anything up to the
    first is linked to anything from the second on, which the least ``low`` so far
    and the largest ``high`` to come tell. So every point has one edge, to the point
    before it. Points of one ``x`` must not be linked. Large groups are cut into
    slices by ``x``, which hand on their extremes and their last linked point.
    """
    group = list(group)
    points, hot = sliced(points, group, [x, id_col], **kw)
    part, order = [*group, "_slice"], [x, id_col]
    up = Window.partitionBy(*part).orderBy(*order)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumns({"_least": F.min(low).over(before), "_no": F.row_number().over(up)})
    # What is to come is added up from the end, in the very same order: a frame that ends with the group starts anew for every row.
    down = Window.partitionBy(*part).orderBy(F.desc("_no"))
    onward, later = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumns({"_most": F.max(high).over(onward), "_after": F.max(high).over(later)}).drop("_no")
    if hot:
        points = cut(points)
        per = points.where("_slice > 0").groupBy(*part).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
        w = Window.partitionBy(*group).orderBy("_slice")
        per = per.select(
            *part, F.min("_low").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_low"), F.max("_high").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_high")
        )
        points = points.join(per, part, "left")
        points = points.withColumns({"_least": F.least("_least", "_low"), "_most": F.greatest("_most", "_high"), "_after": F.greatest("_after", "_high")}).drop("_low", "_high")
    linked = F.coalesce(c(low) < F.col("_after"), F.lit(False)) | F.coalesce(c(high) > F.col("_least"), F.lit(False))
    points = points.where(linked).withColumn("_before", F.lag(id_col).over(up))
    if hot:
        points = cut(points)
        ends = points.where("_slice > 0").groupBy(*part).agg(F.max_by(id_col, F.struct(*order)).alias("_end"))
        # of slices that hold a linked point, the one before
        ends = ends.select(*part, F.lag("_end").over(Window.partitionBy(*group).orderBy("_slice")).alias("_end"))
        points = points.join(ends, part, "left").withColumn("_before", F.coalesce("_before", "_end"))
    joined = points.where(F.col("_before").isNotNull() & (F.col("_least") < F.col("_most")))
    return joined.select(c(id_col).alias("a"), F.col("_before").alias("b")).where("a <> b")


def _progress(df: DataFrame, id_col: str, keys: Sequence[str], position: str, step: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are candidates (step not 0) by place, and every row with the place it asks for."""
    known = df.where(has_all([*keys, position, step]))
    places = known.where(c(step) != 0).select(id_col, *keys, c(position).alias("_at"))
    asks = known.select(id_col, *keys, (c(position) - c(step)).alias("_at"), (c(step) != 0).alias("_own"))
    return places, asks


def progress_edges(df: DataFrame, id_col: str, keys: Sequence[str], position: str, step: str) -> DataFrame:
    """(a, b) edges of the sets of ``progress_links``: the row and every candidate of its place, through the place's smallest row."""
    keys = list(keys)
    places, asks = _progress(df, id_col, keys, position, step)
    asked = progress_links(df, id_col, keys, position, step)
    own = asked.where("set_size > matches").select(F.col(id_col).alias("a"), F.col("partner").alias("b")).where("a <> b")
    head = places.groupBy(*keys, "_at").agg(F.min(id_col).alias("b"), group_size())
    wanted = asks.select(*keys, "_at").distinct()
    members = attach(places, head.join(wanted, [*keys, "_at"], "left_semi"), [*keys, "_at"]).where("b IS NOT NULL").select(F.col(id_col).alias("a"), "b").where("a <> b")
    return own.unionByName(members)


def progress_links(df: DataFrame, id_col: str, keys: Sequence[str], position: str, step: str) -> DataFrame:
    """(id, matches, partner, set_size): rows of the same keys that stand at ``position - step`` and have a step themselves.

    A row with a step belongs to its own set, one without is not a candidate, not
    even its own. A set needs two members. Candidates are added up per (keys,
    position) first, so a row meets one row per place, not every candidate.
    """
    keys = list(keys)
    places, asks = _progress(df, id_col, keys, position, step)
    found = places.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("matches"), F.min(id_col).alias("partner"))
    sizes = asks.groupBy(*keys, "_at").agg(group_size())
    hits = attach(asks, found.join(sizes, [*keys, "_at"]), [*keys, "_at"]).withColumn("set_size", F.col("matches") + F.col("_own").cast("int"))
    return hits.where("set_size > 1").select(id_col, "matches", "partner", "set_size")


def grouping_id(parts: Sequence[str | Column], digits: int = 3) -> Column:
    """Text id from rounded numbers and keys, ``#`` for missing parts."""
    return F.concat_ws("_", *[text(p) for p in parts])


def rounded_text(x: str | Column, digits: int = 3) -> Column:
    """Half-even rounding, printed with a fixed number of digits."""
    return F.bround(c(x), digits).cast(f"decimal(38,{digits})").cast("string")


def duplicate_groups(df: DataFrame, id_col: str, cols: Sequence[str], more_than: int = 1) -> DataFrame:
    """(fingerprint, size, first id) of rows equal in all ``cols``."""
    x = df.select(id_col, F.md5(composite_key(cols, sep="\x1f")).alias("fingerprint"))
    per = x.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"), F.min(id_col).alias("first_id"))
    return per.where(F.col("size") > more_than)


# Value-jump thresholds by counter size, for fresh and for older accounts.
JUMP_STEPS_FRESH = [(5, 2.0), (12, 1.6), (20, 1.3), (30, 1.2), (9999, 1.1)]
JUMP_STEPS_OLD = [(5, 2.0), (12, 1.8), (20, 1.5), (40, 1.4)]
JUMP_STEPS_GAP = [(5, 2.0), (12, 1.8), (20, 1.5), (30, 1.4)]


def jump_threshold(counter: str, age: str, gap: str) -> Column:
    """Largest allowed growth from one row to the next; counters 1, 2, 3 allow their own value."""

    def steps(table, cond):
        x = F.when(cond & c(counter).isin(1, 2, 3), c(counter).cast("double"))
        for top, v in table:
            x = x.when(cond & (c(counter) <= top), v)
        return x

    return F.coalesce(
        steps(JUMP_STEPS_FRESH, (c(age) <= 30) & (c(gap) <= 2)),
        steps(JUMP_STEPS_OLD, c(age) > 30),
        F.when((c(age) > 30) & (c(counter) > 40), 2.0),
        steps(JUMP_STEPS_GAP, c(gap) >= 3),
        F.lit(2.0),
    )


def split_on_jumps(
    df: DataFrame, entity: str, order: Sequence[str], values: Sequence[str], threshold: str, rounds: int = 10, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Split entities where a value grows by more than the row's threshold, repeatedly.

    Each round flags the jumps of every value within the current entity and
    appends the flags to its id. Entities only get smaller, so whether any is too
    large for one task is asked once, unless one is; then every round asks, and
    every round is checkpointed. Otherwise a checkpoint every few rounds will do.
    """
    x = df.withColumn("split_id", c(entity).cast("string"))
    limit = rows_per_split if hot_table(x, ["split_id"], rows_per_split) is not None else None
    for i in range(rounds):
        x = jump_flags(x, ["split_id"], order, {f"_f_{v}": v for v in values}, threshold, rows_per_split=limit)
        x = x.withColumn("split_id", F.concat_ws("-", "split_id", *[F.col(f"_f_{v}").cast("string") for v in values]))
        x = x.drop(*[f"_f_{v}" for v in values])
        if i < rounds - 1 and (limit is not None or i % 4 == 3):
            x = cut(x)
    return x


def leak_split(df: DataFrame, entity: str, period: str, a: str, b: str, gap: float, out: str = "is_leak") -> DataFrame:
    """1 for rows of entities seen in several periods or where two models differ by more than ``gap``."""
    many = multi_period_entities(df, entity, period).select(entity, F.lit(1).alias("_m"), F.col("n_rows").alias(SIZE))
    j = attach(df, many, [entity])
    return j.withColumn(out, F.when(F.col("_m").isNotNull() | (F.abs(c(a) - c(b)) > gap), 1).otherwise(0)).drop("_m")
