"""Greedy chain linking inside blocks.

Rows of a block are read in time order. A row joins the first opened chain whose
latest row it matches and becomes that chain's latest row; otherwise it opens a
chain. A chain keeps the registration day and the part (train or test) of the row
that opened it: rows registered more than a day apart from it never join, and a row
of the other part may join without keeping to the stated gap if the gap ends in the
quiet time between the parts.

Blocks whose registration days lie apart fall into islands that never meet. Ordinary
islands share a task and advance in lock-step, one array call for the k-th rows of all
of them; longer ones look up their open chains by registration day and by the age the
stated gap asks for, so that a row is compared with its neighbours only. An island
above ``rows_per_split`` rows is read in time slices, one per round: each round gets
the open chains of the round before, which keeps the result exact and the rows per
task bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c, epoch_micros, has_all
from ..session import cut
from .attach import attach, group_size
from .windows import ROWS_PER_SPLIT, sliced


@dataclass(frozen=True)
class Tolerance:
    """How far two rows of one owner may lie apart."""

    counter: float = 1
    large: float = 3
    ratio_low: float = 0.8
    ratio_high: float = 1.2
    value: float = 1
    value_gap_low: float = 10
    value_gap_high: float = 100
    value_missing: float = 90000
    counter_limit: float = 1000
    gap_days: float = 1
    registration_days: float = 1


DAY = 86_400_000_000
# Islands of up to this many rows advance in lock-step.
SHORT = 64
BUCKET_ROWS = 200_000

# Columns a row is matched on: account age, stated gap, two counters, two values.
STATE = ["age", "gap", "n1", "n2", "v1", "v2"]


# What the chain remembers of its latest row, and of its first one.
LATEST = [*STATE, "us"]
OPENER = ["reg", "part"]


def matches(tails: np.ndarray, openers: np.ndarray, row: np.ndarray, own: np.ndarray, tol: Tolerance, quiet: tuple[float, float] | None = None) -> np.ndarray:
    """Which chains a later row may continue: ``tails`` and ``row`` hold LATEST, ``openers`` and ``own`` OPENER on the last axis.

    A missing registration day keeps no row out.
    """
    age, gap, n1, n2, v1, v2, us = np.moveaxis(tails, -1, 0)
    r_age, r_gap, r_n1, r_n2, r_v1, r_v2, _ = np.moveaxis(row, -1, 0)
    apart = np.abs(own[..., 0] - openers[..., 0])
    d_age, d_n1, d_n2 = r_age - age, np.abs(r_n1 - n1), np.abs(r_n2 - n2)
    d_v1, d_v2 = np.abs(r_v1 - v1), np.abs(r_v2 - v2)
    with np.errstate(divide="ignore", invalid="ignore"):
        growth = np.abs(r_n1 / n1)
    near = (d_n1 <= tol.counter) & (d_n2 <= tol.counter)
    large = (n1 >= tol.large) & (r_n1 >= tol.large) & (growth >= tol.ratio_low) & (growth <= tol.ratio_high)
    unknown = np.isnan(gap) | np.isnan(r_gap)
    same = lambda d: (d <= tol.value) | (d > tol.value_missing)
    by_counters = (near | large) & same(d_v1) & same(d_v2)
    on_time = np.abs(d_age - r_gap) <= tol.gap_days
    if quiet:
        silent = us - r_gap * DAY
        on_time = on_time | ((own[..., 1] != openers[..., 1]) & (silent >= quiet[0]) & (silent <= quiet[1]))
    jump = lambda d: (d >= tol.value_gap_low) & (d <= tol.value_gap_high)
    sane = (d_n1 <= tol.counter_limit) & (d_n2 <= tol.counter_limit) & ~jump(d_v1) & ~jump(d_v2)
    close = (near & ((d_v1 <= tol.value) | (d_v2 <= tol.value)) & (d_age >= 0)) | (large & (d_age != 0))
    return ~(apart > tol.registration_days) & np.where(unknown, by_counters, on_time & sane & close)


def fold_together(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, fixed: np.ndarray, ids: np.ndarray, tol: Tolerance, quiet) -> np.ndarray:
    """Chain id (the id of its first row) of every row of short blocks, which all take a step at a time."""
    out = np.empty(len(ids), dtype="int64")
    longest_first = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[longest_first], sizes[longest_first]
    room = int(sizes[0])
    tails = np.full((len(starts), room, len(LATEST)), np.nan)
    openers = np.full((len(starts), room, len(OPENER)), np.nan)
    names = np.zeros((len(starts), room), dtype="int64")
    n = np.zeros(len(starts), dtype="int64")
    for step in range(room):
        active = int(np.searchsorted(-sizes, -step, side="left"))
        at, most = starts[:active] + step, int(n[:active].max(initial=0))
        block = np.arange(active)
        row, own = rows[at], fixed[at]
        to = n[:active].copy()
        if most:
            hit = matches(tails[:active, :most], openers[:active, :most], row[:, None], own[:, None], tol, quiet) & (np.arange(most) < to[:, None])
            found = hit.any(axis=1)
            to[found] = hit[found].argmax(axis=1)
        fresh = to == n[:active]
        names[block[fresh], to[fresh]] = ids[at[fresh]]
        openers[block[fresh], to[fresh]] = own[fresh]
        n[:active] += fresh
        tails[block, to] = row
        out[at] = names[block, to]
    return out


class OpenChains:
    """The open chains of one block in the order of their first rows, looked up by registration day and age."""

    def __init__(self, names: np.ndarray, tails: np.ndarray, openers: np.ndarray, tol: Tolerance, quiet):
        self.n, self.tol, self.quiet = 0, tol, quiet
        self.names, self.tails, self.openers = np.zeros(64, dtype="int64"), np.full((64, len(LATEST)), np.nan), np.full((64, len(OPENER)), np.nan)
        self.by_day: dict[float | None, list[int]] = {}
        self.by_part: dict[tuple[float | None, float], list[int]] = {}
        self.by_age: dict[tuple[float | None, float], dict[int, None]] = {}
        self.loose: dict[float | None, dict[int, None]] = {}
        for name, tail, opener in zip(names, tails, openers):
            self._open(name, tail, opener)

    @staticmethod
    def _day(opener: np.ndarray) -> float | None:
        return None if np.isnan(opener[0]) else float(opener[0])

    def _places(self, k: int) -> dict[int, None]:
        """The list that holds chain ``k`` by its latest row."""
        day, age, gap = self._day(self.openers[k]), self.tails[k, 0], self.tails[k, 1]
        if np.isnan(gap):
            return self.loose.setdefault(day, {})
        return self.by_age.setdefault((day, np.floor(age)), {}) if not np.isnan(age) else {}

    def _open(self, name: int, tail: np.ndarray, opener: np.ndarray) -> None:
        k = self.n
        if k == len(self.names):
            self.names = np.concatenate([self.names, np.zeros_like(self.names)])
            self.tails = np.vstack([self.tails, np.full_like(self.tails, np.nan)])
            self.openers = np.vstack([self.openers, np.full_like(self.openers, np.nan)])
        self.names[k], self.tails[k], self.openers[k] = name, tail, opener
        self.n += 1
        day = self._day(opener)
        self.by_day.setdefault(day, []).append(k)
        self.by_part.setdefault((day, opener[1]), []).append(k)
        self._places(k)[k] = None

    def _candidates(self, row: np.ndarray, own: np.ndarray) -> list[int]:
        day, reach = self._day(own), int(self.tol.registration_days)
        days = list(self.by_day) if day is None else [None, *(day + d for d in range(-reach, reach + 1))]
        if np.isnan(row[1]):
            return sorted(k for d in days for k in self.by_day.get(d, ()))
        found = {k for d in days for k in self.loose.get(d, ())}
        asked = row[0] - row[1]
        if not np.isnan(asked):
            ages = np.arange(np.floor(asked - self.tol.gap_days), np.floor(asked + self.tol.gap_days) + 1)
            found.update(k for d in days for a in ages for k in self.by_age.get((d, a), ()))
        if self.quiet:
            found.update(k for (d, part), ks in self.by_part.items() if d in days and part != own[1] for k in ks)
        return sorted(found)

    def add(self, name: int, row: np.ndarray, own: np.ndarray) -> int:
        """The id of the chain that the row continues or opens."""
        some = self._candidates(row, own)
        hit = np.flatnonzero(matches(self.tails[some], self.openers[some], row, own, self.tol, self.quiet)) if some else ()
        if not len(hit):
            self._open(name, row, own)
            return name
        k = some[hit[0]]
        self._places(k).pop(k, None)
        self.tails[k] = row
        self._places(k)[k] = None
        return int(self.names[k])


def with_islands(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the runs of registration days without a gap of more than a day within a key; one run where a day is missing."""
    days = x.groupBy(*keys, "reg").agg(group_size())
    w = Window.partitionBy(*keys)
    broken = F.sum((c("reg") - F.lag("reg").over(w.orderBy("reg")) > 1).cast("int")).over(w.orderBy("reg"))
    missing = F.max(c("reg").isNull().cast("int")).over(w) == 1
    days = days.withColumn("_isle", F.when(missing, 0).otherwise(F.coalesce(broken, F.lit(0))).cast("int"))
    return attach(x, days, [*keys, "reg"], null_safe=True)


def greedy_chains(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    ts: str,
    state: dict[str, str],
    tol: Tolerance = Tolerance(),
    rows_per_split: int = ROWS_PER_SPLIT,
    registered: str | None = None,
    part: str | None = None,
    quiet: tuple[str, str] | None = None,
) -> DataFrame:
    """(id, chain): chain is the id of the chain's first row. ``state`` maps STATE names to columns.

    ``registered`` is a date, ``part`` any value that tells the parts apart, and
    ``quiet`` the first and last moment of the time between them.
    """
    keys = list(keys)
    cols = [c(state[s]).cast("double").alias(s) for s in STATE]
    reg = F.unix_date(c(registered).cast("date")).cast("double") if registered else F.lit(None).cast("double")
    side = F.pmod(F.xxhash64(c(part).cast("string")), F.lit(1 << 50)).cast("double") if part else F.lit(0.0)
    x = df.where(has_all([*keys, ts])).select(*keys, c(id_col).cast("long").alias("_id"), epoch_micros(ts).alias("_us"), *cols, reg.alias("reg"), side.alias("part"))
    x = with_islands(x, keys) if registered else x.withColumn("_isle", F.lit(0))
    keys = [*keys, "_isle"]
    x, any_hot = sliced(x, keys, ["_us", "_id"], rows_per_split)
    span = tuple(float(pd.Timestamp(q).value // 1000) for q in quiet) if quiet else None
    kinds = dict(x.dtypes)
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{key_schema}, _id long, chain long, open boolean, _seq long, " + ", ".join(f"{s} double" for s in [*LATEST, *OPENER])
    nothing = (np.zeros(0, dtype="int64"), np.zeros((0, len(LATEST))), np.zeros((0, len(OPENER))))

    def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        latest = rows[[*STATE, "_us"]].to_numpy(dtype="float64")
        return latest, rows[OPENER].to_numpy(dtype="float64"), rows["_id"].to_numpy()

    def small(rows: pd.DataFrame) -> pd.DataFrame:
        """All islands of one bucket."""
        rows = rows.sort_values([*keys, "_us", "_id"], ignore_index=True)
        starts = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
        sizes = np.diff([*starts, len(rows)])
        latest, fixed, ids = arrays(rows)
        chain = np.empty(len(rows), dtype="int64")
        short = sizes <= SHORT
        if short.any():
            at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[short], sizes[short])])
            begin = np.cumsum(sizes[short]) - sizes[short]
            chain[at] = fold_together(begin, sizes[short], latest[at], fixed[at], ids[at], tol, span)
        for a, n in zip(starts[~short], sizes[~short]):
            chains = OpenChains(*nothing, tol, span)
            chain[a : a + n] = [chains.add(ids[k], latest[k], fixed[k]) for k in range(a, a + n)]
        return pd.DataFrame({"_id": ids, "chain": chain})

    # ordinary islands share groups of about BUCKET_ROWS rows
    plain = x.where("_slice = 0")
    n_buckets = max(1, -(-plain.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).alias("_bucket")
    result = plain.groupBy(bucket).applyInPandas(small, "_id long, chain long")
    if not any_hot:
        return result.withColumnRenamed("_id", id_col)

    def run(rows: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
        rows, tails = rows.sort_values(["_us", "_id"]), tails.sort_values("_seq")
        latest, fixed, ids = arrays(rows)
        chains = OpenChains(tails["chain"].to_numpy(dtype="int64"), tails[LATEST].to_numpy(dtype="float64"), tails[OPENER].to_numpy(dtype="float64"), tol, span)
        chain = [chains.add(ids[k], latest[k], fixed[k]) for k in range(len(ids))]
        done = pd.DataFrame({"_id": ids, "chain": chain, "open": False, "_seq": 0})
        n = chains.n
        left = pd.DataFrame(np.hstack([chains.tails[:n], chains.openers[:n]]), columns=[*LATEST, *OPENER])
        left = left.assign(_id=0, chain=chains.names[:n], open=True, _seq=np.arange(n))
        out = pd.concat([done, left], ignore_index=True)
        for k in keys:
            out[k] = (rows if len(rows) else tails)[k].iloc[0]
        return out[[*keys, "_id", "chain", "open", "_seq", *LATEST, *OPENER]]

    tails = df.sparkSession.createDataFrame([], schema)
    for i in range(1, x.agg(F.max("_slice")).first()[0] + 1):
        rows = x.where(F.col("_slice") == i)
        step = cut(rows.groupBy(*keys).cogroup(tails.groupBy(*keys)).applyInPandas(run, schema))
        result = result.unionByName(step.where("NOT open").select("_id", "chain"))
        tails = step.where("open")
    return result.withColumnRenamed("_id", id_col)
