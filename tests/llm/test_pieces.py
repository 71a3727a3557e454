"""SentencePiece through tables of distinct chunks, against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import pieces

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = ["a", "e", "th", "in", "ing", "▁", " ", "  ", "\n", "\t", "\r", "\x00", "é", "é", "漢", "🙂", "　", "İ", "ß", "1", "!", "...", "haha", "ﬁ", "​", "_", "<0x0A>", "</s>", "aaaa", "\x85", "tion", "er"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Encoder(MODEL)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def want(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def test_random_strings(library, own):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(60, 400))).replace(" ", "") for _ in range(60)]
    for text, (ids, decoded, n) in zip(texts, own.batch(texts)):
        expected = library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, expected)) and n == len(expected), text
        assert decoded == library.decode(expected), text


def test_decoding_any_ids(library, own):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 13, 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert own.pieces.decode(ids) == library.decode(ids), ids


def test_rows_outlive_a_full_table(library):
    enc = pieces.Encoder(MODEL, size=6)
    texts = ["one two three four five six", "six five four seven", "one seven nine", "", "six"]
    for _ in range(3):
        for text in texts:
            assert [x[0] for x in enc.batch([text])] == [" ".join(map(str, library.encode(text, add_eos=True)))]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000 + "a", "\n" * 300_000, "ab " * 100_000, "漢" * 100_000], ids=["letters", "blanks", "lines", "words", "bytes"])
def test_very_long_texts(library, own, text):
    assert own.pieces.encode(text) == library.encode(text, add_eos=True)


def test_tables(spark, edges, no_docs, clashing, library):
    for df in (edges, clashing):
        by = {}
        for r in df.select("doc_id", "text").collect():
            by.setdefault(r.doc_id, set()).add(want(library, r.text))
        got = pieces.encode_digests(df, MODEL).collect()
        assert len(got) == df.count()
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in by[r.doc_id] for r in got)
    assert pieces.encode_digests(no_docs, MODEL).count() == 0


def test_encode_then_decode(spark, edges, no_docs, library):
    got = {(r.doc_id, r.text) for r in pieces.decode_documents(pieces.encode_documents(edges, MODEL), MODEL).collect()}
    assert got == {(r.doc_id, library.decode(library.encode(r.text or "", add_eos=True))) for r in edges.collect()}
    assert pieces.encode_documents(no_docs, MODEL).count() == 0


def test_whole_table(spark, library):
    from ledgerlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_sentencepiece"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, texts[r.doc_id])


def test_other_kinds_of_models_are_refused(monkeypatch):
    class Other:
        def __init__(self, model_file):
            self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def __getattr__(self, name):
            return getattr(self.lib, name)

        def encode(self, text, **kw):
            return [5, *self.lib.encode(text, **kw)]

    class Fake:
        SentencePieceProcessor = Other

    monkeypatch.setattr(pieces, "sentencepiece", Fake)
    with pytest.raises(ValueError):
        pieces.Pieces(MODEL)
