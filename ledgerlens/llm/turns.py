"""Repair of conversation structure by aligning turns to target strings.

A conversation should read ``(s?(ua)+)?``: nothing, or an optional system turn and
then user and assistant turn about. Its turns are edited into that form: a turn is
kept, given another role (user or assistant), or deleted, and turns without text
are inserted. For every feasible length of the alternating target string, a
Wagner-Fischer table holds the least cost of the rest of the turns against the rest
of the target. Cells stay inside an Ukkonen band: a cell is left out if the turns
and targets on both sides of it cost more than the best alignment known so far.
The table is traced back to the audit, the string of the edits' initials; of equal
costs the least audit wins, also between lengths.

A conversation is aligned in slices of at most SLICE turns. A slice has a result
for each pair of places in the grammar that it can start from and end at, and the
slices of a conversation are chained by their least cost and least audit (equal
costs never give audits of which one begins the other, as more letters mean more
insertions; so slice by slice is as good as at once). Ordinary conversations are
one slice and go to a task by their id. Long ones are dealt by ranges of turns:
their slices are aligned by whatever tasks hold them, repeated turns are found by
an aggregate over (conversation, role, text digest), and only the slices' results
meet per conversation. The digest of a long conversation's repaired text runs over
its turns in order, a batch at a time.

Cases: missing values count as one blank, except that a missing turn number sorts
first and counts in no gap; turns with one number ascend by role and text; equal
rows repeat each other; a role is what its first character says, and an empty one
fits nowhere; texts of any length are read whole; a conversation without rows has
zeros, an empty audit and the digest of nothing; an empty table stays empty; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded_batches, name, parts, sized_broadcast

# Turns that are aligned at a time.
SLICE = 64
RETYPE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
NEVER = 1 << 40
BLANKS = " \t\n\v\f\r"
CLOSED = ".!?"
LEGAL = ("su", "ua", "au")
# Places in the grammar: at the start, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = "-sua"
ROLES = {"u": "user", "a": "assistant"}


def target(place: str, length: int, system: bool = False) -> str:
    """The target string of that length from a place on; with ``system`` it begins with a system turn."""
    if system:
        return "s" + target(SYSTEM, length - 1) if length else ""
    pair = "au" if place == USER else "ua"
    return (pair * (length // 2 + 1))[:length]


def coded(initial: str, fault: str) -> str:
    """A turn as two characters: the role's initial, and the fault's (blank, duplicate, truncated) or "."."""
    return (initial or "\0") + (fault or ".")


class Slice:
    """The turns of a slice, two characters each."""

    def __init__(self, codes: str):
        self.turns = turns = list(zip(codes[::2], codes[1::2]))
        self.n = len(turns)
        # Up to each place: turns that must go, broken ones, sound ones.
        self.before = [(0, 0, 0)]
        for _, fault in turns:
            gone, broken, sound = self.before[-1]
            self.before.append((gone + (fault in ("b", "d")), broken + (fault == "t"), sound + (fault == ".")))
        total = self.before[-1]
        self.after = [tuple(t - x for t, x in zip(total, b)) for b in self.before]

    @staticmethod
    def least(counts: tuple[int, int, int], length: int) -> int:
        """A bound on the cost of so many turns against ``length`` targets, whatever their order."""
        gone, broken, sound = counts
        # Sound turns fill places for nothing, broken ones for BROKEN instead of DELETE, insertions for INSERT.
        cost = DELETE * (gone + broken) + DELETE * max(0, sound - length)
        filled = min(broken, max(0, length - sound))
        return cost + (BROKEN - DELETE) * filled + INSERT * max(0, length - sound - broken)

    def band(self, i: int, m: int, bound: int) -> range:
        """The places of the target, last first, where a least alignment of at most ``bound`` can pass turn ``i``.

        The bound on both sides is convex in the place, so the band is one run around its least value.
        """
        before, after = self.before[i], self.after[i]
        both = lambda j: self.least(before, j) + self.least(after, m - j)
        turning = {0, m, before[2], before[1] + before[2], m - after[2], m - after[1] - after[2]}
        best, lo = min((both(j), j) for j in turning if 0 <= j <= m)
        if best > bound:
            return range(0)
        hi = lo
        while lo and both(lo - 1) <= bound:
            lo -= 1
        while hi < m and both(hi + 1) <= bound:
            hi += 1
        return range(hi, lo - 1, -1)

    def align(self, goal: str, bound: int) -> tuple[int, str] | None:
        """(cost, least audit) against ``goal``, or None if it costs more than ``bound``."""
        n, m = self.n, len(goal)
        rows: list[dict[int, int]] = [{} for _ in range(n + 1)]
        for i in range(n, -1, -1):
            row, below = rows[i], rows[i + 1] if i < n else {}
            initial, fault = self.turns[i] if i < n else ("", ".")
            stay = BROKEN if fault == "t" else 0
            may_stay = i < n and fault in ".t"
            for j in self.band(i, m, bound):
                best = 0 if i == n and j == m else NEVER
                if i < n:
                    best = min(best, below.get(j, NEVER) + DELETE)
                if j < m:
                    want = goal[j]
                    if may_stay:
                        if initial == want:
                            best = min(best, below.get(j + 1, NEVER) + stay)
                        elif want != "s":
                            best = min(best, below.get(j + 1, NEVER) + stay + RETYPE)
                    if want != "s":
                        best = min(best, row.get(j + 1, NEVER) + INSERT)
                if best < NEVER:
                    row[j] = best
        cost = rows[0].get(0, NEVER)
        if cost > bound or cost >= NEVER:
            return None
        return cost, self._trace(rows, goal)

    def _trace(self, rows: list[dict[int, int]], goal: str) -> str:
        """Forward along least costs; of the edits that keep to them the least letter."""
        i = j = 0
        out = []
        while i < self.n or j < len(goal):
            here = rows[i][j]
            initial, fault = self.turns[i] if i < self.n else ("", ".")
            stay = BROKEN if fault == "t" else 0
            may_stay = i < self.n and j < len(goal) and fault in ".t"
            if i < self.n and rows[i + 1].get(j, NEVER) + DELETE == here:
                out.append("D")
                i += 1
            elif j < len(goal) and goal[j] != "s" and rows[i].get(j + 1, NEVER) + INSERT == here:
                out.append("I")
                j += 1
            elif may_stay and initial == goal[j] and rows[i + 1].get(j + 1, NEVER) + stay == here:
                out.append("K")
                i, j = i + 1, j + 1
            else:
                out.append("R")
                i, j = i + 1, j + 1
        return "".join(out)

    def best(self, start: str, ends: str) -> dict[str, tuple[int, str]]:
        """For every place in ``ends`` the least (cost, audit) over all target strings that lead there from ``start``."""
        out = {}
        for end in ends:
            best = (NEVER, "")
            goals = sorted(((self.least(self.before[-1], len(g)), g) for g in self._goals(start, end)), key=lambda x: (x[0], len(x[1])))
            for bound, goal in goals:
                if bound > best[0]:
                    break
                found = self.align(goal, best[0])
                if found and found < best:
                    best = found
            if best[0] < NEVER:
                out[end] = best
        return out

    def _goals(self, start: str, end: str) -> Iterator[str]:
        """Target strings from ``start`` to ``end``; more than two insertions a turn never pay."""
        for length in range(0, 2 * self.n + 3):
            for system in (False, True) if start == START and length else (False,):
                goal = target(start, length, system)
                if (goal[-1:] or start) == end:
                    yield goal


@lru_cache(maxsize=20_000)
def edits(codes: str, start: str, ends: str) -> dict[str, tuple[int, str]]:
    """``Slice.best``, remembered, as short conversations are much alike."""
    return Slice(codes).best(start, ends)


class Repaired:
    """The repaired turns, read off an audit while the turns go by; keeps the digest of what it has seen."""

    def __init__(self):
        self.sha, self.place, self.any = hashlib.sha256(), START, False

    def _add(self, role: str, text: str, place: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.place, self.any = place, True

    def feed(self, letters: str, turns: Iterator[tuple[str, str]]) -> None:
        for x in letters:
            expected = "a" if self.place == USER else "u"
            if x == "I":
                self._add(ROLES[expected], "", expected)
                continue
            role, text = next(turns)
            if x == "K":
                self._add(role, text, role[:1])
            elif x == "R":
                self._add(ROLES[expected], text, expected)


# ---- damage


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` after the stated damage; the crc32 of ``conv:turn`` modulo 20 chooses it."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(name(conv).cast("string"), blank), F.lit(":"), F.coalesce(name(turn).cast("string"), blank))
    df = rows.select(
        name(conv).cast("long").alias("conv"),
        name(turn).cast("long").alias("turn"),
        F.coalesce(name(role), blank).alias("role"),
        F.coalesce(name(text), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", CLOSED, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv", "turn", role.alias("role"), words.alias("text"), F.explode(times).alias("copy")).drop("copy")


# ---- ordinary conversations

REPORT = pa.schema(
    [("conv", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
     ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPORT_DDL = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fault(text: str, seen: bool) -> str:
    last = text.rstrip(BLANKS)[-1:]
    return "b" if not last else "d" if seen else "" if last in CLOSED else "t"


def legal(a: str, b: str) -> bool:
    return a + b in LEGAL


def _report(conv: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    seen: set[tuple[str, str]] = set()
    turns = []
    for _, role, text in rows:
        turns.append((role[:1], fault(text, (role, text) in seen)))
        seen.add((role, text))
    count = [sum(f == x for _, f in turns) for x in "bdt"]
    illegal = sum(not legal(a[0], b[0]) for a, b in zip(turns, turns[1:]))
    codes = "".join(coded(*t) for t in turns)
    cost, audit = min(edits(codes, START, START + ASSISTANT).values())
    done = Repaired()
    done.feed(audit, iter([r[1:] for r in rows]))
    return conv, gaps, *count, illegal, cost, audit, done.sha.hexdigest()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and place."""
    held: list[tuple] = []
    now, any_rows, out = None, False, []
    for b in batches:
        for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
            if any_rows and conv != now:
                out.append(_report(now, held))
                held = []
            now, any_rows = conv, True
            held.append(tuple(row))
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), REPORT.types)], schema=REPORT)
            out = []
    if any_rows:
        out.append(_report(now, held))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), REPORT.types)], schema=REPORT)


# ---- long conversations

SLICES = pa.schema([("conv", pa.int64()), ("slice", pa.int64()), ("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("letters", pa.string())])
CHAIN = pa.schema([("conv", pa.int64()), ("slice", pa.int64()), ("letters", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
HASHED = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per slice comes in; a row per pair of places goes out."""
    for b in batches:
        out = []
        for conv, number, turns in zip(*(c.to_pylist() for c in b.columns)):
            codes = "".join(coded(x["initial"], x["fault"]) for x in turns)
            for p in "-sua":
                out += [(conv, number, p, q, cost, letters) for q, (cost, letters) in edits(codes, p, "-sua").items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SLICES.types)], schema=SLICES)


class Way:
    """The letters of the last slice of a way through the slices, and the way before it."""

    __slots__ = ("before", "letters")

    def __init__(self, before: Way | None, letters: str):
        self.before, self.letters = before, letters

    def __lt__(self, other: Way) -> bool:
        """By the audits so far; ways that met before share what they have behind them."""
        a, b, mine, theirs = self, other, [], []
        while a is not b:
            mine.append(a.letters)
            theirs.append(b.letters)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))

    def slices(self) -> list[str]:
        out, now = [], self
        while now is not None:
            out.append(now.letters)
            now = now.before
        return out[::-1]


def chained(states: dict[str, tuple[int, Way | None]], found: dict[str, dict[str, tuple[int, str]]]) -> dict[str, tuple[int, Way]]:
    """Least cost and least audit at every place behind a further slice."""
    out: dict[str, tuple[int, Way]] = {}
    for p, (cost, way) in states.items():
        for q, (more, letters) in found.get(p, {}).items():
            new = (cost + more, Way(way, letters))
            if q not in out or new[0] < out[q][0] or new[0] == out[q][0] and new[1] < out[q][1]:
                out[q] = new
    return out


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices' results, sorted by conversation and slice, to one row of letters per slice; the last one has cost and audit."""

    def finish(conv: int | None, states: dict) -> Iterator[tuple]:
        ends = [states[q] for q in START + ASSISTANT if q in states]
        cost, way = ends[0]
        for other, w in ends[1:]:
            if other < cost or other == cost and w < way:
                cost, way = other, w
        letters = way.slices()
        for k, x in enumerate(letters):
            last = k == len(letters) - 1
            yield conv, k, x, cost if last else None, "".join(letters) if last else None

    def rows() -> Iterator[tuple]:
        now, number, states, found = None, None, {START: (0, None)}, {}
        for b in batches:
            for conv, k, p, q, cost, letters in zip(*(c.to_pylist() for c in b.columns)):
                if number is not None and (conv != now or k != number):
                    states, found = chained(states, found), {}
                    if conv != now:
                        yield from finish(now, states)
                        states = {START: (0, None)}
                now, number = conv, k
                found.setdefault(p, {})[q] = (cost, letters)
        if number is not None:
            yield from finish(now, chained(states, found))

    out = []
    for r in rows():
        out.append(r)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CHAIN.types)], schema=CHAIN)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CHAIN.types)], schema=CHAIN)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and place, the first of a slice with the slice's letters; a slice is held at a time."""
    now, done, letters, held, any_rows = None, Repaired(), "", [], False
    out = []
    for b in batches:
        for conv, _, role, text, more in zip(*(c.to_pylist() for c in b.columns)):
            if any_rows and (more is not None or conv != now):
                done.feed(letters, iter(held))
                held = []
                if conv != now:
                    out.append((now, done.sha.hexdigest()))
                    done = Repaired()
            if more is not None:
                letters = more
            now, any_rows = conv, True
            held.append((role, text))
    if any_rows:
        done.feed(letters, iter(held))
        out.append((now, done.sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), HASHED.types)], schema=HASHED)


def _count(kind: str) -> Column:
    """Turns of a slice with a fault."""
    return F.size(F.filter("turns", lambda x: x["fault"] == kind))


def _long_report(rows: DataFrame, n: int) -> DataFrame:
    """The report of long conversations, without a task that aligns or compares a whole one."""
    order = ["conv", "turn", "role", "text"]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_row").sortWithinPartitions(*order, "_row")
    placed = cut(placed.drop("_row").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = sized_broadcast(runs.select(F.col("conv").alias("c"), F.col("part").alias("p"), "first", F.coalesce(before, F.lit(0)).alias("before")), F.lit(40))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    pos = (F.col("before") + F.col("at") - F.col("first")).alias("pos")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    facts = placed.join(runs, same).select(
        "conv", pos, "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256).alias("what"), last.alias("last")
    )
    facts = cut(facts)
    # The first place of a (role, text); only what repeats is joined back, so that a common turn is one broadcast or split row.
    firsts = facts.where("last <> ''").groupBy("conv", "what").agg(F.min("pos").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = sized_broadcast(firsts.select(F.col("conv").alias("c"), F.col("what").alias("w"), "one"), F.lit(90))
    seen = facts.select("conv", "pos", "turn", "initial", "what", "last").join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("what") == F.col("w")), "left")
    kind = F.when(F.col("last") == "", "b").when(F.col("pos") > F.col("one"), "d").when(F.col("last").isin(*CLOSED), "").otherwise("t")
    slice_ = F.floor(F.col("pos") / SLICE).alias("slice")
    turns = seen.select("conv", slice_, "pos", "turn", "initial", kind.alias("fault"))
    entry = F.sort_array(F.collect_list(F.struct("pos", "turn", "initial", "fault"))).alias("turns")
    slices = cut(turns.groupBy("conv", "slice").agg(entry))
    # Pairs within slices, and those across their borders, where the end of a slice meets the start of the next.
    inner = F.zip_with(F.slice("turns", 1, F.size("turns") - 1), F.slice("turns", 2, F.size("turns")), lambda a, b: F.concat(a["initial"], b["initial"]))
    first, end = F.col("turns")[0]["initial"], F.element_at("turns", -1)["initial"]
    tally = slices.select(
        "conv",
        *(_count(kind).alias(kind) for kind in "bdt"),
        F.size(F.filter(inner, lambda x: ~x.isin(*LEGAL))).alias("illegal"),
    )
    sides = slices.select("conv", "slice", first.alias("a"), F.lit(None).cast("string").alias("b"))
    sides = sides.union(slices.select("conv", F.col("slice") + 1, F.lit(None).cast("string"), end))
    across = sides.groupBy("conv", "slice").agg(F.max("a").alias("a"), F.max("b").alias("b")).where(~F.concat("b", "a").isin(*LEGAL))
    zero = F.lit(0)
    tally = tally.union(across.select("conv", zero, zero, zero, F.lit(1)))
    tally = tally.groupBy("conv").agg(*(F.sum(x).cast("long").alias(y) for x, y in zip(["b", "d", "t", "illegal"], ["blank", "duplicate", "truncated", "illegal"])))
    numbers = rows.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = slices.mapInArrow(_slices, "conv long, slice long, start string, end string, cost long, letters string")
    found = found.repartition(n, "conv").sortWithinPartitions("conv", "slice")
    chain = cut(found.mapInArrow(_chain, "conv long, slice long, letters string, cost long, audit string"))
    heads = chain.select(F.col("conv").alias("c"), (F.col("slice") * SLICE).alias("p"), "letters")
    texts = facts.select("conv", "pos", "role", "text").join(heads, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    texts = texts.select("conv", "pos", "role", "text", "letters").repartition(n, "conv").sortWithinPartitions("conv", "pos")
    hashed = texts.mapInArrow(_digests, "conv long, repaired_sha256 string")
    out = chain.where("cost IS NOT NULL").select("conv", "cost", "audit")
    for table in (tally, numbers, hashed):
        table = table.withColumnRenamed("conv", "_c")
        out = out.join(table, F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(*REPORT.names)


def repair(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One report per conversation of ``all_ids`` (conv) from ``rows`` (conv, turn, role, text without missing roles and texts):
    ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    spark = bounded_batches(rows.sparkSession, 2000)
    size = rows.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0
    n = parts(spark, size)
    counts = cut(rows.groupBy("conv").count().where(F.col("count") > SLICE))
    long_ids = sized_broadcast(counts.select(F.col("conv").alias("c")), F.lit(16))
    same = F.col("conv").eqNullSafe(F.col("c"))
    short = rows.join(long_ids, same, "left_anti").repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text")
    reports = short.mapInArrow(_conversations, REPORT_DDL)
    if not counts.isEmpty():
        reports = reports.unionByName(_long_report(rows.join(long_ids, same, "left_semi"), n))
    ids = all_ids.select(F.col("conv").alias("_c")).distinct()
    zero = F.lit(0).cast("long")
    values = {c: F.coalesce(c, zero) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    values |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    df = ids.join(reports, F.col("_c").eqNullSafe(F.col("conv")), "left")
    return df.select(F.col("_c").alias("conv"), *(v.alias(k) for k, v in values.items()))


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The report on the damaged rows, for every conversation of the undamaged ones."""
    df = repair(damaged(rows, conv, turn, role, text), rows.select(name(conv).cast("long").alias("conv")))
    return df.withColumnRenamed("conv", conv)
