"""The pipeline against plain Python stage by stage, on a small corpus with planted cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import toxicity

from .test_corpus_operators import fill, plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus() -> pd.DataFrame:
    rng = random.Random(12)
    rows = []
    for i in range(240):
        body = [" ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(30)}" for _ in range(12)) for _ in range(4)]
        if i % 5 == 0:
            body[1] += " grobnak zwurfelt quixblat grobnak"
            body[3] += " zwurfelt grobnak"
        rows.append([i, "\n".join(["Common header of the site", *body]), "en", f"s{i % 3 if i % 2 else 0}", 0])
    for i in range(20):  # near copies
        text = rows[3 * i + 1][1].split(" ")
        text[-2] = "changed"
        rows.append([300 + i, " ".join(text), "en", rows[3 * i + 1][3], 0])
    rows += [[400, None, None, None, None], [401, "", "en", "s0", 0], [rows[7][0], *rows[7][1:]], [402, rows[8][1], "en", "s1", 0]]
    df = pd.DataFrame(rows, columns=COLUMNS).astype({"n_chars": "Int64"})
    df["n_chars"] = df["text"].map(lambda t: len(t) if t is not None else None).astype("Int64")
    return df


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = corpus()
    docs.to_parquet(path / "documents.parquet", index=False)
    labels = pd.DataFrame({"doc_id": range(240), "quality": 1, "toxic": [int(i % 5 == 0) for i in range(240)]})
    labels.to_parquet(path / "labels.parquet", index=False)
    return str(path)


def plain_lines(rows: list[tuple]) -> list[tuple]:
    pages = {(r[3], r[1]) for r in rows if r[1] is not None}
    total, having = Counter(s for s, _ in pages), Counter()
    for s, t in pages:
        having.update({(s, x.strip(" \t\r\x0b\x0c")) for x in t.split("\n")})
    out = []
    for r in rows:
        if r[1] is not None:
            bad = lambda x: x.strip(" \t\r\x0b\x0c") and having[r[3], x.strip(" \t\r\x0b\x0c")] >= 3 and having[r[3], x.strip(" \t\r\x0b\x0c")] > 0.1 * total[r[3]]
            kept = [x for x in r[1].split("\n") if not bad(x)]
            text = "\n".join(kept) if any(x.strip() for x in kept) else r[1]
            r = (r[0], text, r[2], r[3], len(text))
        out.append(r)
    return out


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    held = {}
    for (label, stage), plain in zip(corpus_pipeline.STAGES[:4], (plain_toxicity, plain_lines, plain_near, None)):
        got = stage(spark, docs, folder)
        assert got.columns == COLUMNS, label
        found = [tuple(r) for r in got.collect()]
        if plain is not None:
            assert Counter(found) == Counter(plain(rows)), label
        else:
            check_mix(rows, found)
        held[label] = found
        rows = found
        docs = spark.createDataFrame(rows, got.schema)
    ids = {r[0] for r in held["toxicity"]}
    assert sum(i % 5 == 0 for i in ids if i < 240) <= 3 and sum(i % 5 != 0 for i in ids if i < 240) >= 188
    assert all("Common header" not in r[1] for r in held["line dedup"] if r[1])
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert last.columns == ["doc_id", "n_tokens", "ids"]
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == want


def plain_toxicity(rows: list[tuple]) -> list[tuple]:
    labelled = [(r[0], r[1], int(r[0] % 5 == 0)) for r in rows if r[0] < 240 and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.train(labelled)
    distance = toxicity.Distance(model.ordinary, model.toxic)
    return [r for r in rows if model.scores(distance, [r[1]])[0] < 0.5]


def plain_near(rows: list[tuple]) -> list[tuple]:
    groups = {tuple(g) for g in plain_components([r[:2] for r in rows], 5, 80).values()}
    return [min((rows[i] for i in g), key=lambda r: r[0]) for g in groups]


def check_mix(before: list[tuple], after: list[tuple]) -> None:
    size = defaultdict(int)
    for r in before:
        size[r[3]] += len((r[1] or "").split())
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    want = fill(size, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for r in after:
        taken[r[3]] += len((r[1] or "").split())
    longest = max(len((r[1] or "").split()) for r in before)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    assert all(abs(taken[s] - want[s]) <= longest for s in size)


def test_run_equals_its_stages(spark, folder):
    def digest(df):
        return Counter((r.doc_id, r.n_tokens, hashlib.md5(str(list(r.ids)).encode()).hexdigest()) for r in df.collect())

    got = digest(corpus_pipeline.run(spark, folder))
    assert got == digest(corpus_pipeline.run(spark, folder)) and sum(got.values()) > 100


def test_no_documents(spark, tmp_path):
    corpus().iloc[:0].astype({"doc_id": "int64", "text": "string", "lang": "string", "source": "string"}).to_parquet(tmp_path / "documents.parquet", index=False)
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [1]}).to_parquet(tmp_path / "labels.parquet", index=False)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
