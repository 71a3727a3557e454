"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Two levels of Chinese restaurants: one restaurant per context, which is the word
before, hashed to one of ``CONTEXTS``, and their common parent, the restaurant of
all words, over a uniform base of the known words and one place for all unknown
ones. A dish's tables in a context restaurant are the parent's customers. Gibbs
sweeps draw the tables of each dish given its customers and its parent's
probability, in proportion to S(c, t) * a^t (S: generalised Stirling numbers of
the discount, a: the weight of a new table), which seats all customers of the dish
again at once; beyond ``EXACT`` customers the rest is seated in growing blocks. The
predictive probabilities of several sweeps are averaged. Discounts are estimated
from the counts of dishes that occur once and twice.

How it runs: tasks turn their documents into chunks of (word, context, document)
counts, combined per chunk and packed as bytes, which are shuffled once by word
and written to the shared folder. All customers of a word lie in one partition;
words that hold a good share of all tokens are spread over all partitions by
context as well (this affects the layout only). A pass over the written chunks counts
and writes the seated pairs; one pass over these per Gibbs sweep follows, and a last
one over the chunks scores. All dishes of a sweep are drawn at once, given the tables
of contexts and parent that the sweep before drew. Between passes only vectors of
fixed size go through the driver: customers and tables per context, totals, and the
rows of frequent words. Draws are hashes of word, context and sweep, so that a pass
repeats what the ones before drew, on any executor, and the last one has the exact
normalisers of the samples.

Cases: a missing or empty text is one end token; documents with a missing id count
as held out; repeated rows are rows of their own; without training documents
all words are unknown; texts of any length are scored whole, with a row for each
word, context and document; ties do not occur, as draws are hashes; an empty table
gives an empty result. Only id and text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded_batches, lower_words, name, parts, text_bytes
from .near import WordHashes

CONTEXTS = 1 << 16
# Bytes of text in a chunk, and documents at most.
CHUNK, CHUNK_DOCS = 10 << 20, 1 << 15
# Bytes of text whose words share a partition.
PARTITION = 32 << 20
# Buckets of words per partition.
SPREAD = 4
BURN, SAMPLES = 2, 3
STRENGTH = 1.0
EXACT = 256
# Least share of a frequent word in all tokens, and words a task counts before it passes them on.
FREQUENT, COUNTED = 1 / 2000, 1 << 18

END = xxhash.xxh3_64_intdigest(b"\n")
BEGIN = xxhash.xxh3_64_intdigest(b"\t")
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M2
    z = (z ^ (z >> np.uint64(27))) * _M3
    return z ^ (z >> np.uint64(31))


def _uniform(key: np.ndarray, sweep: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the sweep alone."""
    step = np.uint64((int(_M) * (sweep + 1)) & 0xFFFFFFFFFFFFFFFF)
    return ((_mix(key + step) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def context_of(words: np.ndarray) -> np.ndarray:
    """The restaurant of each word as a context."""
    return (_mix(words * _M) >> np.uint64(48)).astype(np.int64) % CONTEXTS


# ---- chunks: what a task's documents say about words, contexts and documents


def _pack(words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, docs: np.ndarray, entries: np.ndarray, times: np.ndarray) -> bytes:
    """Words with their number of pairs; pairs with context and number of entries; entries with document and times."""
    sizes = np.array([len(words), len(contexts), len(docs)], np.int64)
    body = b"".join(
        (sizes.tobytes(), words.astype(np.uint64).tobytes(), pairs.astype(np.uint32).tobytes(), contexts.astype(np.uint16).tobytes(),
         entries.astype(np.uint16).tobytes(), docs.astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes())
    )
    return zstandard.compress(body, 1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    body = zstandard.decompress(data)
    n = np.frombuffer(body, np.int64, 3)
    at, out = 24, []
    for count, kind in ((n[0], np.uint64), (n[0], np.uint32), (n[1], np.uint16), (n[1], np.uint16), (n[2], np.uint16), (n[2], np.uint32)):
        out.append(np.frombuffer(body, kind, count, at))
        at += int(count) * np.dtype(kind).itemsize
    return tuple(out)


ROW = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("data", pa.binary()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64())])
ROW_SPEC = "bucket int, base long, data binary, doc_id long, train boolean, n_tokens long"


def chunk(tokens: list[np.ndarray], train: list[bool], buckets: int, frequent: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed counts) of a chunk's documents, each given as its word hashes with the end."""
    flat = np.concatenate(tokens)
    size = np.array([len(t) for t in tokens])
    doc = np.repeat(np.arange(len(tokens)), size)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(size) - size] = BEGIN
    words, w = np.unique(flat, return_inverse=True)
    # Sorted by word, context, document.
    entry, times = np.unique((w << 31) | (context_of(before) << 15) | doc, return_counts=True)
    pair = entry >> 15
    w, k = pair >> 16, pair & 0xFFFF
    spread = np.isin(words, frequent)
    home = (_mix(words) >> np.uint64(20)).astype(np.int64)
    bucket = (home[w] + np.where(spread[w], k * 40503, 0)) % buckets
    order = np.argsort(bucket, kind="stable")
    docs = (entry & 0x7FFF) | (np.array(train)[entry & 0x7FFF].astype(np.int64) << 15)
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for at, to in zip(edges, [*edges[1:], len(order)]):
        mine = order[at:to]
        p, wi = pair[mine], w[mine]
        new_pair = np.flatnonzero(np.diff(p, prepend=-1))
        pw = wi[new_pair]
        new_word = np.flatnonzero(np.diff(pw, prepend=-1))
        yield int(bucket[mine[0]]), _pack(
            words[pw[new_word]],
            np.diff([*new_word, len(pw)]),
            k[mine][new_pair],
            docs[mine],
            np.diff([*new_pair, len(p)]) - 1,
            times[mine],
        )


def _chunks(buckets: int, frequent: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, next_id = WordHashes(), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bool, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            ids, train, tokens = zip(*held)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * n, pa.int32()), pa.array(range(next_id, next_id + n), pa.int64()), pa.nulls(n, pa.binary()),
                 pa.array(ids, pa.int64()), pa.array(train, pa.bool_()), pa.array([len(t) for t in tokens], pa.int64())], schema=ROW)
            for b, data in chunk(list(tokens), list(train), buckets, frequent):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([next_id], pa.int64()), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64())],
                    schema=ROW,
                )
            next_id += n

        for b in batches:
            for i, train, text in zip(*(c.to_pylist() for c in b.columns)):
                words = lower_words(text)
                held.append((i, bool(train), np.array([*(hashes[x] for x in words), END], np.uint64)))
                size += len(text or "")
                if size > CHUNK or len(held) == CHUNK_DOCS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


# ---- the model


@dataclass
class Totals:
    """What the driver knows between passes; every array has a fixed or bounded size."""

    customers: np.ndarray  # per context
    tables: np.ndarray  # per context, at the start: dishes
    tokens: int = 0
    words: int = 0
    parent: int = 0  # customers of the parent at the start
    discount: float = 0.5  # of contexts
    discount_top: float = 0.5  # of the parent
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    frequent_tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    frequent_customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    # Per sweep: tables per context, (customers, tables) of the parent, and of its frequent words.
    sweeps: list[tuple[np.ndarray, tuple[float, float], tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    def kept(self) -> range:
        """The sweeps whose probabilities are averaged."""
        return range(min(BURN, len(self.sweeps) - 1), len(self.sweeps))

    def before(self, sweep: int) -> tuple[np.ndarray, tuple[float, float], tuple[np.ndarray, np.ndarray]]:
        """What a sweep starts from: what the one before drew, or a table per dish."""
        if sweep:
            return self.sweeps[sweep - 1]
        return self.tables, (self.parent, self.words), (self.frequent_customers, np.minimum(self.frequent_customers, 1))

    def rest(self, all_tables: float) -> float:
        """The parent's weight of a new table of a dish."""
        return (STRENGTH + self.discount_top * all_tables) / (self.words + 1)

    def base(self, customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float) -> np.ndarray:
        """The parent's probability of a dish."""
        return (customers - self.discount_top * tables + self.rest(all_tables)) / (STRENGTH + all_customers)


_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t), c and t from 0 to EXACT."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0.0
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = np.log(np.maximum(c - discount * t, 1e-300)) + out[c, t]
            out[c + 1, t] = np.logaddexp(out[c, t - 1], np.where(c - discount * t > 0, stay, -np.inf))
        _stirling.clear()
        _stirling[discount] = out
    return _stirling[discount]


def draw_tables(customers: np.ndarray, new: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers, given the weight of a new table; ``u`` are uniform draws."""
    out = np.minimum(customers, 1).astype(float)
    log_s = stirling(discount)
    c = np.minimum(customers, EXACT).astype(np.int64)
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    edges = np.flatnonzero(np.diff(c[many], prepend=-1))
    for at, to in zip(edges, [*edges[1:], len(many)]):
        n = int(c[many[at]])
        for lo in range(at, to, 100_000):
            rows = many[lo : min(to, lo + 100_000)]
            t = np.arange(1, n + 1)
            x = log_s[n, 1 : n + 1] + t * np.log(new[rows])[:, None]
            x = np.cumsum(np.exp(x - x.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (x < (u[rows] * x[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(customers > EXACT)
    if len(big):
        # The rest in blocks of an eighth of those seated; a block's tables are rounded at random.
        total, a, t, r = customers[big].astype(float), new[big], out[big], u[big]
        seated, step = float(EXACT), 0
        while (total > seated).any():
            block = np.maximum(0.0, np.minimum(np.ceil(seated / 8), total - seated))
            r = (r * 9301.0 + 0.2113 * (step + 1)) % 1.0
            t = t + np.floor(block * a / (a + seated - discount * t) + np.where(block > 0, r, 0.0))
            seated, step = seated + np.ceil(seated / 8), step + 1
        out[big] = np.minimum(t, total)
    return out


class Seated:
    """Words, pairs (word, context) and their customers."""

    words: np.ndarray
    w: np.ndarray
    k: np.ndarray
    customers: np.ndarray

    def _keys(self, frequent: np.ndarray) -> None:
        at = np.searchsorted(frequent, self.words)
        at = np.minimum(at, max(0, len(frequent) - 1))
        self.is_frequent = frequent[at] == self.words if len(frequent) else np.zeros(len(self.words), bool)
        self.frequent_at = at
        self.word_key = _mix(self.words * _M)
        self.pair_key = _mix(self.words[self.w] * _M2 + self.k.astype(np.uint64))

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, x, len(self.words))

    def sweeps(self, totals: Totals, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per sweep: tables of the pairs, and customers and tables of the words in the parent (in part only for frequent words).

        All dishes of a sweep are drawn given the tables of the sweep before, in the contexts and in the parent.
        """
        d, top = totals.discount, totals.discount_top
        f = self.frequent_at[self.is_frequent]
        customers = self.per_word((self.customers > 0).astype(float))
        parent_tables = np.minimum(customers, 1)
        for sweep in range(n):
            in_context, (all_customers, all_tables), (shared, shared_tables) = totals.before(sweep)
            customers[self.is_frequent], parent_tables[self.is_frequent] = shared[f], shared_tables[f]
            p = totals.base(customers, parent_tables, all_customers, all_tables)
            tables = draw_tables(self.customers, (STRENGTH + d * in_context[self.k]) * p[self.w], d, _uniform(self.pair_key, sweep))
            customers = self.per_word(tables)
            parent_tables = draw_tables(customers, np.full(len(customers), totals.rest(all_tables)), top, _uniform(self.word_key, sweep))
            yield tables, customers, parent_tables


class Seats(Seated):
    """What ``Partition.seated`` packed."""

    def __init__(self, data: bytes, frequent: np.ndarray):
        body = zstandard.decompress(data)
        n_words, n = (int(x) for x in np.frombuffer(body, np.int64, 2))
        self.words = np.frombuffer(body, np.uint64, n_words, 16)
        at = 16 + 8 * n_words
        self.w = np.repeat(np.arange(n_words), np.frombuffer(body, np.uint32, n_words, at))
        self.customers = np.frombuffer(body, np.uint32, n, at + 4 * n_words).astype(np.int64)
        self.k = np.frombuffer(body, np.uint16, n, at + 4 * n_words + 4 * n).astype(np.int64)
        self._keys(frequent)


class Partition(Seated):
    """All chunks of a partition, merged: words, pairs (word, context) and their customers."""

    def __init__(self, batches: Iterable[pa.RecordBatch], frequent: np.ndarray):
        self.base: list[int] = []
        raw = []
        for b in batches:
            self.base += b.column(0).to_pylist()
            raw += [_unpack(x) for x in b.column(1).to_pylist()]
        self.empty = not raw
        if self.empty:
            return
        words, pairs, contexts, entries, docs, times = zip(*raw)
        self.words, w = np.unique(np.concatenate(words), return_inverse=True)
        w = np.repeat(w, np.concatenate(pairs).astype(np.int64))
        pair, self.pair_of = np.unique((w << 16) | np.concatenate(contexts).astype(np.int64), return_inverse=True)
        self.w, self.k = pair >> 16, pair & 0xFFFF
        self.entries = [e.astype(np.int64) + 1 for e in entries]
        self.docs, self.times = docs, times
        n = np.concatenate(self.entries)
        train = np.concatenate([(d >> 15) * t.astype(np.int64) for d, t in zip(docs, times)])
        each = np.add.reduceat(train, np.cumsum(n) - n)
        self.customers = np.bincount(self.pair_of, each, len(pair)).astype(np.int64)
        self._keys(frequent)

    def seated(self) -> bytes:
        """Words and pairs with customers, packed for ``Seats``."""
        some = np.flatnonzero(self.customers)
        there, pairs = np.unique(self.w[some], return_counts=True)
        sizes = np.array([len(there), len(some)], np.int64)
        body = b"".join(
            (sizes.tobytes(), self.words[there].tobytes(), pairs.astype(np.uint32).tobytes(), self.customers[some].astype(np.uint32).tobytes(), self.k[some].astype(np.uint16).tobytes())
        )
        return zstandard.compress(body, 1)


# Sums by kind: keys and two values.
Sums = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
SUMS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])
SUMS_SPEC = "kind int, key long, a double, b double"
FIRST = SUMS.append(pa.field("data", pa.binary()))


def _sums(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key.astype(np.int64)), pa.array(a, pa.float64()), pa.array(b, pa.float64())], schema=SUMS)


def _per_context(kind: int, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = np.bincount(k, a, CONTEXTS), np.bincount(k, b, CONTEXTS)
    some = np.flatnonzero((x != 0) | (y != 0))
    return _sums(kind, some, x[some], y[some])


def _counts(p: Seated) -> Iterator[pa.RecordBatch]:
    """Kind 0: customers and dishes per context; 1: totals; 2: tokens and contexts of frequent words."""
    seen = (p.customers > 0).astype(float)
    yield _per_context(0, p.k, p.customers.astype(float), seen)
    tokens, contexts = p.per_word(p.customers), p.per_word(seen)
    own = ~p.is_frequent
    total = [
        (p.customers.sum(), seen.sum()),
        ((p.customers == 1).sum(), (p.customers == 2).sum()),
        ((tokens[own] > 0).sum(), 0),
        ((contexts[own] == 1).sum(), (contexts[own] == 2).sum()),
    ]
    yield _sums(1, np.arange(len(total)), np.array([x for x, _ in total], float), np.array([y for _, y in total], float))
    f = np.flatnonzero(p.is_frequent)
    yield _sums(2, p.frequent_at[f], tokens[f], contexts[f])


def _count(frequent: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Partition(batches, frequent)
        if not p.empty:
            yield from _counts(p)

    return run


def _first(frequent: np.ndarray):
    """The sums of ``_count``, and the partition's words and pairs for the sweeps (kind -1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Partition(batches, frequent)
        if p.empty:
            return
        for b in _counts(p):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], schema=FIRST)
        one = pa.array([-1], pa.int32()), pa.array([0]), pa.array([0.0]), pa.array([0.0]), pa.array([p.seated()], pa.binary())
        yield pa.RecordBatch.from_arrays(list(one), schema=FIRST)

    return run


def _swept(p: Seated, totals: Totals) -> Iterator[pa.RecordBatch]:
    """The next sweep. Kind 10: tables per context; 20: customers and tables of the parent; 30: customers of frequent words."""
    for tables, customers, parent_tables in p.sweeps(totals, len(totals.sweeps) + 1):
        pass
    own, f = ~p.is_frequent, np.flatnonzero(p.is_frequent)
    yield _per_context(10, p.k, tables, np.zeros(len(tables)))
    yield _sums(20, np.zeros(1), np.array([customers[own].sum()]), np.array([parent_tables[own].sum()]))
    yield _sums(30, p.frequent_at[f], customers[f], np.zeros(len(f)))


def _gibbs(totals: Totals):
    """The next sweep over chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Partition(batches, totals.frequent)
        if not p.empty:
            yield from _swept(p, totals)

    return run


def _sweep(totals: Totals):
    """The next sweep over what ``_first`` packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from _swept(Seats(data, totals.frequent), totals)

    return run


PACK = np.dtype([("doc", "<u2"), ("known", "<u4"), ("score", "<f8"), ("base", "<f8")])
SUM_SPEC = "rid long, score double, base double, known long"


def _add_up(table: pa.Table) -> pa.Table:
    """Sums per document of one chunk over the partitions of words."""
    packs = np.frombuffer(b"".join(table["data"].to_pylist()), PACK)
    there = np.flatnonzero(np.bincount(packs["doc"], minlength=1))
    score, base, known = (np.bincount(packs["doc"], packs[f])[there] for f in ("score", "base", "known"))
    return pa.table({"rid": pa.array(table["base"][0].as_py() + there), "score": score, "base": base, "known": pa.array(known.astype(np.int64))})


def _score(totals: Totals):
    """Per chunk, the sums of its documents over the partition's words, packed."""
    schema = pa.schema([("base", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Partition(batches, totals.frequent)
        if p.empty:
            return
        f, at = np.flatnonzero(p.is_frequent), p.frequent_at[p.is_frequent]
        probability = np.zeros(len(p.k))
        d = totals.discount
        for s, (tables, customers, parent_tables) in enumerate(p.sweeps(totals, len(totals.sweeps))):
            if s not in totals.kept():
                continue
            in_context, of_parent, (shared, shared_tables) = totals.sweeps[s]
            customers, parent_tables = customers.copy(), parent_tables.copy()
            customers[f], parent_tables[f] = shared[at], shared_tables[at]
            top = totals.base(customers, parent_tables, *of_parent)
            probability += (p.customers - d * tables + (STRENGTH + d * in_context[p.k]) * top[p.w]) / (STRENGTH + totals.customers[p.k])
        log_p = np.log10(probability / len(totals.kept()))
        tokens = p.per_word(p.customers)
        tokens[f] = totals.frequent_tokens[at]
        log_base, known = np.log10(tokens + 0.1)[p.w], (tokens > 0).astype(float)[p.w]
        # A partition gives one row per chunk of documents.
        ends = np.cumsum([len(e) for e in p.entries])
        for base, blobs in groupby(sorted(range(len(p.base)), key=p.base.__getitem__), key=p.base.__getitem__):
            x, y, z = (np.zeros(CHUNK_DOCS) for _ in range(3))
            there = np.zeros(CHUNK_DOCS, bool)
            for i in blobs:
                pair = np.repeat(p.pair_of[ends[i] - len(p.entries[i]) : ends[i]], p.entries[i])
                doc = (p.docs[i] & 0x7FFF).astype(np.int64)
                n = p.times[i].astype(float)
                there[doc] = True
                for out, v in ((x, log_p), (y, log_base), (z, known)):
                    out += np.bincount(doc, n * v[pair], CHUNK_DOCS)
            some = np.flatnonzero(there)
            pack = np.empty(len(some), PACK)
            pack["doc"], pack["score"], pack["base"], pack["known"] = some, x[some], y[some], z[some]
            yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([pack.tobytes()], pa.binary())], schema=schema)

    return run


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often the task's texts hold them; the word NULL stands for all."""
    count: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in count], np.uint64).view(np.int64)
        n = pa.array([*count.values(), sum(count.values())], pa.int64())
        count.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(words, pa.int64()), pa.nulls(1, pa.int64())]), n], names=["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            count.update(lower_words(text))
            count[b"\n"] += 1  # the end of a text
            if len(count) > COUNTED:
                yield flush()
    yield flush()


def frequent_words(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of the words that hold a good share of all tokens. Decides where words lie, not what they score.

    Held-out texts count as well, because their tokens lie where the word lies.
    """
    count = docs.select(name(text)).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # At most 1 / FREQUENT words can hold that share, and the sum of all stands above them.
    top = count.orderBy(F.desc("n"), F.col("word").asc_nulls_first()).limit(round(1 / FREQUENT) + 1).collect()
    total = next((r.n for r in top if r.word is None), 0)
    return np.sort(np.array([r.word for r in top if r.word is not None and r.n >= FREQUENT * total], np.int64).view(np.uint64))


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95))


def _collect(df: DataFrame) -> Sums:
    """Sums by kind: keys and two values. At most a row per context, sample and frequent word."""
    rows = df.groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    return {int(kind): tuple(g[c].to_numpy() for c in ("key", "a", "b")) for kind, g in rows.groupby("kind")}


def _dense(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(n), np.zeros(n)
    if found is not None:
        a[found[0]], b[found[0]] = found[1], found[2]
    return a, b


def first_totals(found: Sums, frequent: np.ndarray) -> Totals:
    """The state before sampling, from the sums of the counting pass."""
    totals = Totals(*_dense(found.get(0), CONTEXTS), frequent=frequent)
    tokens, shared = _dense(found.get(2), len(frequent))
    total, second = _dense(found.get(1), 4)
    totals.frequent_tokens, totals.frequent_customers = tokens, shared
    totals.tokens, totals.parent = int(total[0]), int(second[0])
    totals.words = int(total[2]) + int((tokens > 0).sum())
    totals.discount = _discount(total[1], second[1])
    totals.discount_top = _discount(total[3] + (shared == 1).sum(), second[3] + (shared == 2).sum())
    return totals


def add_samples(found: Sums, totals: Totals) -> None:
    """The totals that a sweep drew, from its sums; frequent words get their tables in the parent here, by the same rule and draw as the others."""
    sweep = len(totals.sweeps)
    _, (_, all_tables), _ = totals.before(sweep)
    customers = _dense(found.get(30), len(totals.frequent))[0]
    tables = draw_tables(customers, np.full(len(customers), totals.rest(all_tables)), totals.discount_top, _uniform(_mix(totals.frequent * _M), sweep))
    own_customers, own_tables = _dense(found.get(20), 1)
    top = float(own_customers[0] + customers.sum()), float(own_tables[0] + tables.sum())
    totals.sweeps.append((_dense(found.get(10), CONTEXTS)[0], top, (customers, tables)))


def language_model_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    ``train`` tells which documents the model learns from (missing: no).
    """
    spark = bounded_batches(docs.sparkSession)
    frequent = frequent_words(docs, text)
    n = parts(spark, text_bytes(docs, text), PARTITION)
    rows = docs.select(name(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), name(text).alias("text"))
    made = cut(rows.mapInArrow(_chunks(SPREAD * n, frequent), ROW_SPEC).repartition(n, F.coalesce(F.nullif(F.col("bucket"), F.lit(-1)).cast("long"), F.col("base"))))
    chunks = made.where("bucket >= 0").select("base", "data")
    first = cut(chunks.mapInArrow(_first(frequent), f"{SUMS_SPEC}, data binary"))
    totals = first_totals(_collect(first.where("kind >= 0")), frequent)
    for _ in range(BURN + SAMPLES):
        add_samples(_collect(first.where("kind < 0").select("data").mapInArrow(_sweep(totals), SUMS_SPEC)), totals)
    scored = chunks.mapInArrow(_score(totals), "base long, data binary").groupBy("base").applyInArrow(_add_up, SUM_SPEC)
    own = made.where("bucket < 0").select(F.col("base").alias("rid"), "doc_id", "train", "n_tokens")
    norm = float(np.log10(totals.tokens + 0.1 * (totals.words + 1)))
    return own.join(scored, "rid").select(
        F.col("doc_id").alias(doc_id),
        "train",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
