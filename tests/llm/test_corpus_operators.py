"""Operators that compare documents: line dedup, mixing, exact and near dedup, language model, pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact, lines, lm, mixing, near
from ledgerlens.llm.common import LOWER_BYTES
from ledgerlens.llm.components import components


def lower(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER_BYTES)


def as_set(df, cols) -> Counter:
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- line dedup


def test_lines_by_share_of_a_host(spark):
    rows = [("h", f"header\narticle {i}\n\n  footer  ") for i in range(10)] + [("h", "header"), ("other", "header\nx"), ("other", "y"), (None, "header\nz"), ("h", None), ("h", "")]
    rows += [("h", "copied line")] * 4
    df = spark.createDataFrame(rows, "host string, body string").withColumn("n_lines", F.lit("own"))
    got = lines.line_dedup(df, "host", "body", max_share=0.5, min_pages=3)
    assert got.columns == ["host", "body", "n_lines", "n_dropped"]
    out = as_set(got, ["host", "body", "n_lines", "n_dropped"])
    want = Counter({("h", f"article {i}\n", 4, 2): 1 for i in range(10)})
    # Nothing but boilerplate: left alone. Copies of a page count once, so their line stays.
    want += Counter({("h", "header", 1, 0): 1, ("other", "header\nx", 2, 0): 1, ("other", "y", 1, 0): 1, (None, "header\nz", 2, 0): 1})
    want += Counter({("h", None, 0, 0): 1, ("h", "", 1, 0): 1, ("h", "copied line", 1, 0): 4})
    assert out == want


def test_lines_edges(edges, no_docs, clashing):
    assert lines.line_dedup(no_docs, "source", "text").count() == 0
    got = lines.line_dedup(clashing, "source", "text")
    assert got.count() == clashing.count() and set(clashing.columns) <= set(got.columns)
    assert as_set(lines.line_dedup(edges, "source", "text"), ["doc_id", "text"]) == as_set(edges, ["doc_id", "text"])


# ---- mixing


def fill(sizes: dict, weights: dict, share: float, epochs: int) -> dict:
    """Round after round: cap who is above, share the rest again."""
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = [s for s in free if target[s] > epochs * sizes[s]]
        if not above:
            return capped | target
        capped |= {s: float(epochs * sizes[s]) for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets_and_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "B", "é", "zz", None, "c"][: 3 + seed]), "w " * rng.choice([0, 1, 5, 40, 200])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_documents(df).collect()
    sizes: dict = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken: dict = defaultdict(int)
    whole: dict = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        whole[r.source] += r.repetitions * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1
        assert abs(whole[s] - want[s]) <= 201
    again = {(r.doc_id, r.taken) for r in mixing.mix_documents(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mixing_edges(spark, edges, no_docs, clashing):
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.repeat_documents(no_docs).count() == 0
    got = mixing.mix_documents(clashing).collect()
    assert len(got) == clashing.count()
    assert all(r.taken <= 2 * r.size for r in got)
    # Rows with the same id share a hash and are cut alike.
    same = {(r.taken, r.repetitions) for r in got if r.doc_id == 22}
    assert len(same) == 1
    assert mixing.repeat_documents(clashing).columns == clashing.columns
    n = {r.doc_id: r.repetitions for r in mixing.mix_documents(edges.where("doc_id < 12")).collect()}
    assert as_set(mixing.repeat_documents(edges.where("doc_id < 12")), ["doc_id"]) == Counter({(i,): k for i, k in n.items() if k})


# ---- exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("limit", [None, 1000])
def test_exact_groups(edges, monkeypatch, keep, limit):
    groups: dict = defaultdict(list)
    for r in edges.collect():
        groups[lower(r.text)].append(r.doc_id)
    want: Counter = Counter()
    for data, ids in groups.items():
        known = [i for i in ids if i is not None]
        owner = (min if keep == "min" else max)(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda x: x != owner)):
            want[(i, owner, len(ids), k == 0, hashlib.sha256(data).hexdigest())] += 1
    got = exact.exact_groups(edges, keep=keep)
    assert as_set(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == want


def test_exact_edges(no_docs, clashing):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.exact_groups(clashing).count() == clashing.count()


def test_trie_holds_and_spills_every_string():
    rng = random.Random(2)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(500)] + [b"x" * 5000, b"x" * 4999 + b"y"] * 3
    trie, out = exact.Trie(min), Counter()
    owner: dict = {}
    for i, x in enumerate(data):
        trie.add(x, i)
        if i % 97 == 96:
            for d, o, n in trie.spill(2000):
                out[d] += n
                owner[d] = min(o, owner.get(d, o))
    for d, o, n in trie.terminals():
        out[d] += n
        owner[d] = min(o, owner.get(d, o))
    assert out == Counter(data)
    assert owner == {x: data.index(x) for x in set(data)}


# ---- near dedup


def shingles(text: str | None, width: int) -> frozenset:
    w = lower(text).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(rows: list, width: int, percent: int) -> dict:
    """Row number to the row numbers of its component, over all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out: dict = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return {i: g for g in out.values() for i in g}


def check_near(df, width: int):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    groups = plain_components(rows, width, 80)
    want: Counter = Counter()
    for i, (doc, text) in enumerate(rows):
        ids = [rows[k][0] for k in groups[i] if rows[k][0] is not None]
        want[(doc, len(shingles(text, width)), min(ids) if ids else None)] += 1
    got = near.near_groups(df, width=width)
    assert as_set(got, ["doc_id", "n_shingles", "component_id"]) == want
    kept = got.where("kept").collect()
    assert len(kept) == len({tuple(g) for g in groups.values()})
    assert all(r.doc_id == r.component_id for r in kept)


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_of_edge_rows(edges, width):
    check_near(edges, width)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_groups_around_the_threshold(spark, monkeypatch, block):
    """A large group whose members are near the threshold of each other, so that pivots alone miss links."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 5, 6, 7])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i * 3 % 160, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(300)}" for _ in range(50))) for i in range(30)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_cross_block_misses_no_pair():
    """The bounds inside a block never drop a pair at the threshold."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    stock = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(stock, rng.integers(150, 250))) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[rng.integers(0, 8) :], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for s in sets]
    sig = near.minima(sets)
    n = len(sets)
    table = pa.table({
        "uid": list(range(n)), "root": list(range(n)), "n": [len(s) for s in sets], "sig": [x.tobytes() for x in sig],
        "cells": [near.cells(s).tobytes() for s in sets], "left": [True] * n, "right": [True] * n, "outside": [True] * n,
    })
    got = near._cross(80)(table)
    found = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    for j in range(n):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found


def test_near_edges(no_docs, clashing):
    assert near.near_groups(no_docs).count() == 0
    assert near.near_groups(clashing).count() == clashing.count()
    one = near.keep_one(clashing, width=5)
    assert one.columns == clashing.columns
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    assert one.count() == len({tuple(g) for g in plain_components(rows, 5, 80).values()})
    assert near.keep_one(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(205, 203), (203, 205), (203, 203), (204, 203)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {k: 100 for k in range(100, 140)} | {203: 203, 204: 203, 205: 203}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language model


def test_language_model_counts_and_gain(spark, edges, no_docs):
    rng = random.Random(4)
    pairs = [f"w{k} v{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(pairs) for _ in range(40))) for i in range(300)] + [(r.doc_id, r.text) for r in edges.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = lm.language_model_scores(df, train).collect()
    tokens = [(i, lower(t).split() + [None]) for i, t in rows]
    learns = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in tokens]
    count: Counter = Counter()
    for (_, w), y in zip(tokens, learns):
        if y:
            count.update(w)
    total, words = sum(count.values()), len(count)
    want = Counter()
    for (i, w), y in zip(tokens, learns):
        base = sum(np.log10((count[x] + 0.1) / (total + 0.1 * (words + 1))) for x in w)
        want[(i, y, len(w), sum(count[x] > 0 for x in w), total, round(base, 4))] += 1
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    plain = [r for r in got if not r.train and r.doc_id is not None and r.doc_id < 300 and r.n_tokens == 81]
    assert plain and all(r.score > 0.7 * r.base_score for r in plain)  # every second word follows from the one before
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(r.doc_id, round(r.score, 9)) for r in lm.language_model_scores(df, train).collect()}
    assert lm.language_model_scores(no_docs, F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0, 4])
@pytest.mark.parametrize("buckets", [1, 3])
def test_probabilities_sum_to_one(spread, buckets):
    """After every context, over the known words and the unknown one; also with words spread over partitions."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    vocabulary = rng.integers(1, 1 << 63, 20, dtype=np.uint64)
    share = 2.0 ** -(np.arange(20) / 2)
    learnt = [rng.choice(vocabulary, 60, p=share / share.sum()) for _ in range(40)] + [vocabulary]
    unknown = np.array([12345], np.uint64)
    after = [0, 3, 19]
    probes = [vocabulary[a : a + 1] for a in after]
    probes += [np.concatenate([vocabulary[a : a + 1], [w]]).astype(np.uint64) for a in after for w in [*vocabulary, *unknown]]
    tokens = learnt + probes
    frequent = np.sort(vocabulary[:spread])
    packed = list(lm.chunk(tokens, [True] * len(learnt) + [False] * len(probes), buckets, frequent))
    parts = [pa.record_batch({"base": [0], "data": [d]}) for _, d in packed]

    def sums(step) -> lm.Sums:
        out: dict = {}
        for part in parts:
            for b in step([part]):
                for kind, key, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    at = out.setdefault(kind, {}).setdefault(key, [0.0, 0.0])
                    at[0] += x
                    at[1] += y
        return {k: tuple(np.array(c) for c in zip(*((key, x, y) for key, (x, y) in v.items()))) for k, v in out.items()}

    totals = lm.first_totals(sums(lm._count(frequent)), frequent)
    assert (totals.tokens, totals.words) == (40 * 60 + 20, 20)
    lm.add_samples(sums(lm._gibbs(totals)), totals)
    score = np.zeros(len(tokens))
    for part in parts:
        for b in lm._score(totals)([part]):
            pack = np.frombuffer(b.column(1)[0].as_py(), lm.PACK)
            np.add.at(score, pack["doc"], pack["score"])
    single = score[len(learnt) : len(learnt) + 3]
    double = score[len(learnt) + 3 :].reshape(3, 21)
    assert (10 ** (double - single[:, None])).sum(axis=1) == pytest.approx([1.0] * 3, abs=1e-9)


def lm_scores(tokens: list, train: list[bool], buckets: int, frequent: np.ndarray, sweeps: int) -> tuple[np.ndarray, lm.Totals]:
    """Scores of token lists, and the totals after so many sweeps."""
    import pyarrow as pa

    parts = [pa.record_batch({"base": [0], "data": [d]}) for _, d in lm.chunk(tokens, train, buckets, frequent)]

    def sums(step) -> lm.Sums:
        rows = [r for part in parts for b in step([part]) for r in b.to_pylist()]
        out: dict = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0]))
        for r in rows:
            at = out[r["kind"]][r["key"]]
            at[0] += r["a"]
            at[1] += r["b"]
        return {k: tuple(np.array(c) for c in zip(*((key, x, y) for key, (x, y) in v.items()))) for k, v in out.items()}

    totals = lm.first_totals(sums(lm._count(frequent)), frequent)
    for _ in range(sweeps):
        lm.add_samples(sums(lm._gibbs(totals)), totals)
    score = np.zeros(len(tokens))
    for part in parts:
        for b in lm._score(totals)([part]):
            pack = np.frombuffer(b.column(1)[0].as_py(), lm.PACK)
            np.add.at(score, pack["doc"], pack["score"])
    return score, totals


def some_tokens(n: int) -> list[np.ndarray]:
    rng = np.random.default_rng(8)
    vocabulary = rng.integers(1, 1 << 63, 20, dtype=np.uint64)
    share = 2.0 ** -(np.arange(20) / 2)
    return [rng.choice(vocabulary, 60, p=share / share.sum()) for _ in range(n)]


def test_scores_do_not_depend_on_the_layout():
    """Frequent words are seated like the others."""
    tokens = some_tokens(60)
    words, count = np.unique(np.concatenate(tokens), return_counts=True)
    train = [i % 5 > 0 for i in range(60)]
    want, _ = lm_scores(tokens, train, 1, np.zeros(0, np.uint64), 5)
    for top in (3, len(words)):
        got, _ = lm_scores(tokens, train, 3, np.sort(words[np.argsort(-count)[:top]]), 5)
        assert got == pytest.approx(want, abs=1e-9)


def test_sweeps_see_the_tables_drawn_before():
    """The weights of a sweep come from the tables of the one before, in the contexts and in the parent."""
    tokens = some_tokens(200)
    _, totals = lm_scores(tokens, [True] * 200, 2, np.zeros(0, np.uint64), 5)
    seen = [totals.before(s) for s in range(6)]
    for s in range(1, 6):
        assert seen[s][0] is totals.sweeps[s - 1][0] and seen[s][1] == totals.sweeps[s - 1][1]
        assert seen[s][0].sum() == seen[s][1][0] > totals.tables.sum()  # tables of contexts are customers of the parent


def test_frequent_words_of_late_texts(spark):
    """A word past the first texts and deep in a long one, in any order of the rows."""
    rows = [(i, "a b c " * 10) for i in range(3000)] + [(3000, " ".join(f"x{k}" for k in range(8000)) + " late" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(lm.WordHashes()[w] for w in (b"a", b"b", b"c", b"late", b"\n"))
    assert lm.frequent_words(df, "text").tolist() == want
    assert lm.frequent_words(df.orderBy(F.desc("doc_id")).repartition(7), "text").tolist() == want
    assert len(lm.frequent_words(df.limit(0), "text")) == 0


def test_table_draws_follow_their_distribution():
    """Exact draws against seating customers one by one with the same weights, by their means."""
    rng = np.random.default_rng(1)
    discount, weight, n = 0.6, 0.8, 12
    got = lm.draw_tables(np.full(20000, n), np.full(20000, weight), discount, rng.random(20000))
    log_s = lm.stirling(discount)
    t = np.arange(1, n + 1)
    p = np.exp(log_s[n, 1 : n + 1] + t * np.log(weight))
    p /= p.sum()
    assert got.mean() == pytest.approx((t * p).sum(), abs=0.05)
    assert log_s[3, 2] == pytest.approx(np.log(3 * (1 - discount)))
    many = lm.draw_tables(np.full(500, 5000), np.full(500, 2.0), 0.5, rng.random(500))
    assert (many >= 1).all() and (many <= 5000).all() and many.std() > 0
    assert list(lm.draw_tables(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, np.array([0.5, 0.5]))) == [0, 1]
