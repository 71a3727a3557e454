"""Conversation repair against every way through the grammar, turn by turn, and against SQL."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from check import compare
from ledgerlens.llm import turns
from ledgerlens.llm.sql import SQL

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def plain_best(rows):
    """Least (cost, audit, repaired) over all edits, by the place reached after each turn; rows are (role, text, fault)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for p, (c, a, t) in list(out.items()):
                q, new = after[p], (c + 5, a + "I", (*t, f"{names[after[p]]}:"))
                out[q] = min(out.get(q, new), new)
        return out

    def ways(states):
        """Every number of insertions, not only the cheapest to a place."""
        for p, x in states.items():
            yield p, x
            for _ in range(2):
                c, a, t = x
                p, x = after[p], (c + 5, a + "I", (*t, f"{names[after[p]]}:"))
                yield p, x

    states = {"": (0, "", ())}
    for role, text, fault in rows:
        found = {}
        for p, (c, a, t) in ways(states):
            options = [(p, (c + 2, a + "D", t))]
            if fault in ("", "t"):
                more, q = 5 * (fault == "t"), after[p]
                if role[:1] == q or p == "" and role[:1] == "s":
                    options.append((role[:1], (c + more, a + "K", (*t, f"{role}:{text}"))))
                options.append((q, (c + more + 1, a + "R", (*t, f"{names[q]}:{text}"))))
            for q, x in options:
                found[q] = min(found.get(q, x), x)
        states = found
    return min(x for p, x in ways(states) if p in ("", "a"))


def exhaustive(rows):
    """All edit strings with at most one insertion between turns and two at the end, no dynamic programming."""
    best = None
    n = len(rows)
    for ops in itertools.product("DKua", repeat=n):
        for ins in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
            cost, audit, out = 0, "", []
            for k in range(n + 1):
                for x in ins[k]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((x, ("user:" if x == "u" else "assistant:")))
                if k == n:
                    break
                role, text, fault = rows[k]
                op = ops[k]
                if op == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if fault in ("b", "d"):
                    cost = 1000
                cost += 5 * (fault == "t")
                if op == "K":
                    audit += "K"
                    out.append((role[:1], f"{role}:{text}"))
                else:
                    cost, audit = cost + 1, audit + "R"
                    out.append((op, ("user:" if op == "u" else "assistant:") + text))
            if cost < 1000 and re.fullmatch("(s?(ua)+)?", "".join(x for x, _ in out) if all(x for x, _ in out) else "?"):
                new = (cost, audit, tuple(t for _, t in out))
                best = new if best is None else min(best, new)
    return best


def damage(rows):
    out = []
    for k, (conv, turn, role, text) in enumerate(rows):
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_report(rows):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r[1:])
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = {r[0] for r in found} - {None}
        seen, marked = set(), []
        for _, role, text in found:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            marked.append((role, text, "b" if not last else "d" if (role, text) in seen else "" if last[0] in ".!?" else "t"))
            seen.add((role, text))
        pairs = zip(marked, marked[1:])
        cost, audit, kept = plain_best(marked)
        out.append((
            conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(sum(m[2] == x for m in marked) for x in "bdt"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, sha256("\n".join(kept).encode()).hexdigest(),
        ))
    return out


def key(x):
    return tuple(map(str, x))


def coded(rows):
    return "".join(turns.coded(role[:1], fault) for role, _, fault in rows)


def some_turns(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "x", ""]), f"t{k}", rng.choice(["", "", "", "t", "b", "d"])) for k in range(n)]


def test_small_cases_against_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = some_turns(rng, rng.randint(0, 3))
        want = exhaustive(rows)
        assert plain_best(rows) == want
        assert min(turns.edits(coded(rows), "-", "-a").values()) == want[:2], rows


def test_slices_against_turn_by_turn():
    rng = random.Random(4)
    for n in [5, 9, 17, 30, 64]:
        for _ in range(12):
            rows = some_turns(rng, n)
            cost, audit, kept = plain_best(rows)
            assert min(turns.edits(coded(rows), "-", "-a").values()) == (cost, audit), rows
            done = turns.Repaired()
            done.feed(audit, iter([r[:2] for r in rows]))
            assert done.sha.hexdigest() == sha256("\n".join(kept).encode()).hexdigest()


def test_chained_slices_equal_one():
    rng = random.Random(5)
    for _ in range(60):
        rows = some_turns(rng, rng.randint(1, 24))
        states = {"-": (0, None)}
        for at in range(0, len(rows), 4):
            part = coded(rows[at : at + 4])
            states = turns.chained(states, {p: turns.edits(part, p, "-sua") for p in "-sua"})
        got = min((c, "".join(w.slices())) for q, (c, w) in states.items() if q in "-a")
        assert got == plain_best(rows)[:2], rows


def test_bands_leave_nothing_out():
    rng = random.Random(6)
    for _ in range(40):
        rows = some_turns(rng, rng.randint(1, 12))
        s = turns.Slice(coded(rows))
        for length in range(0, 14, 2):
            goal = turns.target("-", length)
            free = s.align(goal, turns.NEVER)
            assert free is None or s.align(goal, free[0]) == free
            assert free is None or s.align(goal, free[0] - 1) is None


def table():
    rng = random.Random(7)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn + rng.randint(0, 1) * (conv % 5 == 0), role, rng.choice(["Yes.", "no", "", " \n", "a\n. \t", "é!", "Same?", f"w{rng.random()}."])))
    rows += [(None, 0, "user", "x."), (None, None, None, None), (None, None, "assistant", "y."), (500, None, "user", None), (501, 3, None, "z."), (502, 1, "", "r.")]
    rows += [(503, 1, "user", "q" * 400_000 + " " * 400_000), (503, 2, "assistant", "b."), (504, 1, "user", "tie."), (504, 1, "assistant", "tie."), (504, 1, "user", "tie.")]
    return rows


def long_table():
    """Conversations of several slices, one of them under a missing id, turns that repeat across slices, a slice border between illegal roles."""
    rng = random.Random(8)
    rows = []
    for conv, n in ((1, 64), (2, 65), (3, 200), (None, 150), (4, 300)):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "system"]) if rng.random() < 0.15 else ["user", "assistant"][turn % 2]
            rows.append((conv, None if conv == 4 and turn < 70 else turn * 2, role, rng.choice([f"t{turn}.", f"u{turn}!", "again.", "", f"open {turn}"])))
    return rows + table()


@pytest.mark.parametrize("rows", [table(), long_table()], ids=["short", "long"])
def test_report_against_the_plain_one(spark, rows):
    got = [tuple(r) for r in turns.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(plain_report(rows), key=key)


def test_clashing_names_repeated_rows_and_empty_table(spark):
    rows = table()
    df = spark.createDataFrame(rows + rows, SCHEMA)
    extra = df.select("*", *(F.lit("own").alias(x) for x in "conv pos slice kind copy count c p letters a.b".split()))
    got = [tuple(r) for r in turns.repair_report(extra).collect()]
    assert sorted(got, key=key) == sorted(plain_report(rows + rows), key=key)
    assert turns.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [table(), long_table()], ids=["short", "long"])
def test_report_against_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    got = turns.repair_report(df).toPandas().astype({"conv_id": "Int64"})
    assert compare(got, con.execute(SQL["op11_conversation_repair"]).df().astype({"conv_id": "Int64"})) == ""


def test_a_slice_stays_cheap():
    """Cells of a band, not of the whole table."""
    rng = random.Random(9)
    rows = [(["user", "assistant"][k % 2], f"{k}", rng.choice([""] * 18 + ["t", "d"])) for k in range(turns.SLICE)]
    s = turns.Slice(coded(rows))
    cost, _ = min(s.best("-", "-a").values())
    m = len([r for r in rows if r[2] == ""]) // 2 * 2
    assert sum(len(s.band(i, m, cost)) for i in range(s.n + 1)) < (s.n + 1) * (m + 1) / 4
