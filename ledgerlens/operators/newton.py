"""Linear and logistic models by weighted normal equations, many of them at once.

A fit needs the sums of products of its columns, weighted by what the model says so
far: one aggregate of the size of the column list for each step. The models of all
held-out folds and of all candidate column lists read the same rows, so that every
step is a single pass over one prepared and written frame, however many models there
are. The driver only solves the small systems. Scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, no_nan
from ..session import cut

FILL = -1.0
STEPS = 25
CLOSE = 1e-10


@dataclass(frozen=True)
class Linear:
    """A fitted model; missing values count as ``fill``."""

    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    logistic: bool
    fill: float = FILL

    def score(self) -> Column:
        """The probability of class 1, or the prediction of a regression."""
        total = F.lit(self.intercept)
        for n, b in zip(self.names, self.coefficients):
            total = total + F.coalesce(no_nan(c(n).cast("double")), F.lit(self.fill)) * F.lit(b)
        return 1 / (1 + F.exp(-total)) if self.logistic else total


def _pass(frame: DataFrame, models: list[tuple[np.ndarray, int]], betas: list[np.ndarray], origin: np.ndarray, scale: np.ndarray, logistic: bool) -> list[tuple]:
    """(products, slopes, loss) of every model, summed over all rows."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(b) * (len(b) + 1) + 1) for b in betas]
        for batch in batches:
            y, weight, fold, *cols = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            x = np.column_stack([np.ones(len(y)), (np.column_stack(cols) - origin) / scale if cols else np.zeros((len(y), 0))])
            for m, ((use, held), beta) in enumerate(zip(models, betas)):
                z = x[:, use]
                w = np.where(fold == held, 0.0, weight)
                if logistic:
                    eta = z @ beta
                    p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                    slope, bend, loss = y - p, p * (1 - p), np.logaddexp(0, eta) - y * eta
                else:
                    slope, bend, loss = y, np.ones(len(y)), np.zeros(len(y))
                h = z.T @ (z * (w * bend)[:, None])
                total[m] += np.concatenate([h.ravel(), z.T @ (w * slope), [w @ loss]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["m", "sums"])

    rows = frame.mapInArrow(sums, "m int, sums array<double>").select("m", F.posexplode("sums").alias("at", "v"))
    found = [np.zeros(len(b) * (len(b) + 1) + 1) for b in betas]
    # as many rows as all the systems have entries
    for r in rows.groupBy("m", "at").agg(F.sum("v").alias("v")).collect():
        found[r["m"]][r["at"]] = r["v"]
    return [(s[: len(b) ** 2].reshape(len(b), -1), s[len(b) ** 2 : -1], s[-1]) for s, b in zip(found, betas)]


def fit_many(
    df: DataFrame, label: str, designs: Sequence[Sequence[str]], logistic: bool = True, fold: str | None = None, held: Sequence = (), weight: str | None = None, fill: float = FILL
) -> list[list[Linear]]:
    """Per column list of ``designs`` a model for each value of ``fold`` in ``held``, fitted without its rows; one on all rows if there is none.

    Rows without a label are left out. Logistic models take Newton steps, halved
    where the loss would rise, until no coefficient of any model moves.
    """
    names = list(dict.fromkeys(n for d in designs for n in d))
    side = F.lit(-1)
    for i, v in enumerate(held):
        side = F.when(c(fold) == F.lit(v), i).otherwise(side)
    cols = [F.coalesce(no_nan(c(n).cast("double")), F.lit(fill)).alias(f"x{i}") for i, n in enumerate(names)]
    w = c(weight).cast("double") if weight else F.lit(1.0)
    frame = cut(df.where(c(label).isNotNull()).select(c(label).cast("double").alias("y"), w.alias("w"), side.alias("fold"), *cols))
    spread = frame.agg(F.count(F.lit(1)), *[f(f"x{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop)]).first()
    origin = np.array([m or 0.0 for m in spread[1::2]])
    scale = np.array([s or 1.0 for s in spread[2::2]])
    models = [(np.array([0, *(names.index(n) + 1 for n in d)]), f) for d in designs for f in (range(len(held)) if held else [-2])]
    betas = [np.zeros(len(use)) for use, _ in models]
    if logistic:
        last, step = [np.inf] * len(models), [np.zeros(len(b)) for b in betas]
        for _ in range(STEPS):
            for m, (h, g, loss) in enumerate(_pass(frame, models, betas, origin, scale, True)):
                if loss > last[m] + 1e-9 * abs(last[m]):
                    step[m] = step[m] / 2
                    betas[m] = betas[m] - step[m]
                    continue
                last[m], step[m] = loss, np.linalg.lstsq(h, g, rcond=1e-12)[0]
                betas[m] = betas[m] + step[m]
            if max(np.abs(s).max(initial=0) for s in step) < CLOSE:
                break
    else:
        betas = [np.linalg.lstsq(h, g, rcond=1e-12)[0] for h, g, _ in _pass(frame, models, betas, origin, scale, False)]
    done = []
    for (use, _), beta in zip(models, betas):
        b = beta[1:] / scale[use[1:] - 1]
        done.append(Linear(tuple(names[k - 1] for k in use[1:]), tuple(map(float, b)), float(beta[0] - b @ origin[use[1:] - 1]), logistic, fill))
    per = max(1, len(held))
    return [done[k : k + per] for k in range(0, len(done), per)]


def fit_one(df: DataFrame, label: str, cols: Sequence[str], logistic: bool = True, weight: str | None = None) -> Linear:
    return fit_many(df, label, [cols], logistic, weight=weight)[0][0]
