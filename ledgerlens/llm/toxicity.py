"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on windows of
ordinary documents, one on the words that toxic documents use far more often
than ordinary ones do. A window of a few words is compressed with the ordinary
dictionary and with the ordinary plus the toxic one; what the second saves is the
window's distance. A document's score is a logistic function of how many of its
windows pass the thresholds and of their mean and highest distances; its weights
are calibrated on labelled documents seen through dictionaries of other documents.

The fit takes a bounded sample of the labelled rows: ``SAMPLE`` rows of each class,
those with the smallest hash of their id, texts of at most ``SAMPLE_CHARS``
characters. Scoring covers every window of every text, in the scan's tasks, and
its cost is linear in the text.

Cases: missing and empty texts get the score of a text without windows; without
both classes in the labels every score is the share of toxic labels (0 without
labels); labels that are missing are not used; repeated rows are scored alike;
an empty table stays empty. Only id and text are read, and only the text is scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, name

# Bound of the fit: rows of each class (toxic, ordinary), and characters of a row.
SAMPLE = {1: 2000, 0: 5000}
SAMPLE_CHARS = 40_000
# Words of a window, and the longest word; a longer one is cut into several.
WINDOW, LONGEST = 8, 64
# Most bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 2 << 10
# A letter sequence is toxic if at least LEAST toxic documents hold it, TIMES as many as the ordinary
# rate gives and SIGMA standard deviations more. Each one makes room for GRAM_BYTES of the dictionary.
GRAM, LEAST, TIMES, SIGMA, GRAM_BYTES = 5, 3, 3.0, 8.0, 12
# Thresholds of a window's distance, in bytes.
STEPS = (2, 3, 4, 6)
EDGE = ".,!?;:"


def words(text: str | None) -> list[str]:
    found = (text or "").lower().split()
    if found and max(map(len, found)) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [" ".join(w[i : i + WINDOW]).encode("utf-8", "surrogatepass") for i in range(0, len(w), WINDOW)]


def _grams(word: str) -> set[str]:
    w = f" {word.strip(EDGE)} "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def _dictionary(size: int, samples: list[bytes], **how: int) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


class Distance:
    """Bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.both = [self._compressor(ordinary), self._compressor(ordinary + toxic)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        how = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(data) < 8:
            return zstandard.ZstdCompressor(**how)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **how)

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        a, b = (c.multi_compress_to_buffer(found, threads=1) for c in self.both)
        return np.array([len(a[i]) - len(b[i]) for i in range(len(found))], float)


def features(distance: Distance, texts: list[str | None]) -> np.ndarray:
    """One row per text: how many windows pass each threshold (as log shares), mean, highest two, number of windows."""
    found = [windows(t) for t in texts]
    x = distance([w for ws in found for w in ws])
    out = np.zeros((len(texts), len(STEPS) + 4))
    at = 0
    for i, ws in enumerate(found):
        n = len(ws)
        v = np.sort(x[at : at + n])[::-1] if n else np.zeros(1)
        at += n
        n = max(1, n)
        out[i] = [math.log((np.count_nonzero(v >= s) + 0.02 * n + 0.3) / (n + 1)) for s in STEPS] + [
            np.clip(v, -3, 8).mean(),
            min(v[0], 12),
            min(v[1] if len(v) > 1 else 0, 12),
            math.log(n + 1),
        ]
    return out


@dataclass
class Model:
    """Dictionaries and the calibrated weights; ``weights`` is None if there was nothing to tell apart."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    prior: float

    def scores(self, distance: Distance, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        z = (features(distance, texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


Row = tuple[int | None, str, int]


def dictionaries(rows: list[Row]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled rows of both classes."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for _, t, y in rows:
        n[y] += 1
        counts[y].update(set().union(*map(_grams, set(words(t)))))

    def marked(gram: str, k: int) -> bool:
        expected = n[1] * (counts[0][gram] + 0.5) / n[0]
        return k >= LEAST and k > TIMES * expected and k - expected > SIGMA * expected**0.5

    marks = {g for g, k in counts[1].items() if marked(g, k)}
    own = [[w.strip(EDGE) for w in words(t) if _grams(w) & marks] for _, t, y in rows if y]
    ordinary = sorted({w for _, t, y in rows if not y for w in windows(t)}, key=lambda w: (zlib.crc32(w), w))[:100_000]
    toxic = [" ".join(w).encode("utf-8", "surrogatepass") for w in own if w]
    size = max(256, min(TOXIC_BYTES, GRAM_BYTES * len(marks)))
    return _dictionary(ORDINARY_BYTES, ordinary), _dictionary(size, toxic, k=16, d=8)


def train(rows: Iterable[tuple[int | None, str | None, int]]) -> Model:
    """A model of (id, text, toxic) rows; equal texts count once.

    The weights see each row through dictionaries of the other two thirds; the
    model's dictionaries are those of all rows.
    """
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1] or ""))
    once: list[Row] = list({t or "": (i, t or "", int(y > 0)) for i, t, y in rows}.values())
    prior = sum(y for *_, y in once) / len(once) if once else 0.0
    thirds: list[list[Row]] = [[], [], []]
    for r in once:
        thirds[zlib.crc32(f"third:{r[0]}".encode()) % 3].append(r)
    x, y = [], []
    for k, part in enumerate(thirds):
        rest = [r for j in range(3) if j != k for r in thirds[j]]
        if part and len({r[2] for r in rest}) == 2:
            x.append(features(Distance(*dictionaries(rest)), [t for _, t, _ in part]))
            y += [r[2] for r in part]
    if len(set(y)) < 2:
        return Model(b"", b"", None, None, None, prior)
    z, labels = np.concatenate(x), np.array(y, float)
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = np.c_[np.ones(len(z)), (z - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(len(w)), z.T @ (labels - p) - w)
    return Model(*dictionaries(once), mean, scale, w, prior)


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model fitted on a bounded sample of labelled documents (see the module)."""
    rows = labelled.select(name(doc_id).alias("id"), name(text).alias("text"), name(toxic).cast("int").alias("toxic"))
    rows = rows.where("toxic IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= SAMPLE_CHARS)
    order = F.xxhash64(F.concat(F.lit("sample:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("h", order)
    found = []
    for y, n in SAMPLE.items():
        # The hash bound that leaves about n rows keeps the texts out of the sort.
        some = rows.where((F.col("toxic") > 0) == F.lit(y == 1))
        top = some.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
        if top is not None:
            found += [tuple(r) for r in some.where(F.col("h") <= top).select("id", "text", "toxic").limit(n).collect()]
    return train(found)


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for b in batches:
            score = model.scores(distance, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], schema=schema)

    return run


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``: 0 to 1, higher if the toxic label is likelier."""
    bounded_batches(docs.sparkSession)
    return docs.select(name(doc_id).cast("long").alias("doc_id"), name(text).alias("text")).mapInArrow(_score(model), "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text", level: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``level``, columns unchanged."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for b in batches:
            yield b.filter(pa.array(model.scores(distance, b.column(at).to_pylist()) < level, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
