"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can end its encoding:
the token matches a suffix of the prefix, and it is compatible with the last
token of the prefix that is left when it is taken off. Two tokens are compatible
if encoding their concatenation gives these two tokens again, which undoing their
merges from the latest to the earliest decides. The suffix matches come from an
automaton over the vocabulary; the last tokens are stored per prefix and
followed back from the whole word, so that a word costs time linear in its length.

The last byte of a word carries the word end: it is mapped to a letter of its
own, so that words and tokens are plain strings over 512 letters. Words repeat,
and each worker keeps a bounded memory of those it has encoded. The normaliser
(NFC, white space, lower case), the split into words and the special strings are
those of the tokenizer file; the file's path is a parameter and must exist on
every executor.

Cases: missing and empty texts give no tokens; special strings inside a text
become their ids; texts of any length are encoded whole, word by word; work is
per row, so that repeated rows and ties do not matter; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, name

# Unicode white space as the file's expressions mean it (without the separators U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Words that a worker remembers; the older half goes when they are more.
MEMORY = 400_000
PAIRS = 600_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = end = model["end_of_word_suffix"]
        letters = byte_letters()
        byte_of = {x: b for b, x in enumerate(letters)}
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_ids = special
        self.tokens = {i: t for t, i in (self.ids | special).items()}
        # The word pattern, with its white space spelled out.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"), regex.V0)

        def spelled(token: str) -> str:
            """Over 512 letters: bytes, and bytes that end a word."""
            last = token.endswith(end)
            bytes_ = [byte_of[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, bytes_[:-1])) + chr(bytes_[-1] + 256 * last)

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        self.formed, self.left, self.right = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            t = self.ids[a + b]
            if t not in self.formed:
                self.formed[t], self.left[t], self.right[t] = r, self.ids[a], self.ids[b]
        self.automaton = ahocorasick.Automaton()
        # Pairs of tokens (before << 20 | token) and whether they are compatible; forgotten beyond PAIRS.
        self.fits: dict[int, bool] = {}
        for token, i in self.ids.items():
            if len(token) == 1 or token[:-len(end)] in byte_of and token.endswith(end):
                self.formed.setdefault(i, -1)
        for token, i in self.ids.items():
            # A token that its own merge would not give back is never emitted.
            if self.formed[i] < 0 or self._compatible(self.left[i], self.right[i], self.formed[i]):
                s = spelled(token)
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def _compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Does no merge cross the border of tokens ``a`` and ``b``? With ``before``, none earlier than that merge."""
        most = len(self.rank) if before is None else before
        bound_a = bound_b = most
        first = before is not None
        while True:
            r = self.rank.get((a, b))
            # A merge inside ``a`` comes first at the same rank, as it lies further left.
            if not first and r is not None and r < bound_a and r <= bound_b and r < most:
                return False
            first = False
            fa, fb = self.formed[a], self.formed[b]
            if fa < 0 and fb < 0:
                return True
            if fa > fb:
                bound_a, a = fa, self.right[a]
            else:
                bound_b, b = fb, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        data = data[:-1] + chr(ord(data[-1]) + 256)
        n = len(data)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        fits, rank_ok = self.fits, self._compatible
        for at, (token, size) in self.automaton.iter(data):
            i = at + 1
            if last[i] >= 0:
                continue  # found: it is the only one
            j = i - size
            if j:
                before = last[j]
                if before < 0:
                    continue
                pair = before << 20 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > PAIRS:
                        fits.clear()
                    ok = fits[pair] = rank_ok(before, token)
                if not ok:
                    continue
            last[i], back[i] = token, j
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def normal(self, text: str) -> str:
        # Lower case letter by letter: a sigma does not look at its place in the word. White space
        # needs no folding, as no word holds any.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special?, word) in text order."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield True, part
            elif part:
                for w in self.words.findall(self.normal(part)):
                    yield False, w

    def encode(self, text: str) -> list[int]:
        return [i for special, w in self.pieces(text) for i in ([self.special_ids[w]] if special else self.encode_word(w))]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a blank, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    return Bpe(path)


class Memory(dict):
    """Word to (ids as text, tokens as text); words of the half before are looked up there first."""

    def __init__(self, bpe: Bpe, before: dict[str, tuple[str, str]]):
        self.bpe, self.before = bpe, before

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.before.get(word)
        if found is None:
            ids = self.bpe.encode_word(word)
            found = (" ".join(map(str, ids)), self.bpe.decode(ids))
        self[word] = found
        return found


class Encoder:
    """Whole texts to (ids as text, decoded text, number of tokens), with a bounded memory of words."""

    def __init__(self, bpe: Bpe, words: int | None = None):
        self.bpe, self.memory, self.words = bpe, Memory(bpe, {}), words or MEMORY

    def text(self, text: str) -> tuple[str, str, int]:
        bpe, memory = self.bpe, self.memory
        if bpe.special and bpe.special.search(text):
            ids = bpe.encode(text)
            return " ".join(map(str, ids)), bpe.decode(ids), len(ids)
        if len(memory) > self.words // 2:
            memory = self.memory = Memory(bpe, dict(memory))
        found = [memory[w] for w in bpe.words.findall(bpe.normal(text))]
        if not found:
            return "", "", 0
        ids = " ".join([x[0] for x in found])
        return ids, " ".join([x[1] for x in found]), ids.count(" ") + 1


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, words: int | None = None) -> Encoder:
    """One per worker process."""
    if (path, words) not in _encoders:
        _encoders.clear()
        _encoders[path, words] = Encoder(load(path), words)
    return _encoders[path, words]


def _encode(path: str, words: int | None):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, words)
        for b in batches:
            ids = [np.fromstring(enc.text(t or "")[0], np.int32, sep=" ") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)

    return run


def _digests(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            done = []
            for t in b.column(1).to_pylist():
                ids, decoded, n = enc.text(t or "")
                done.append((n, sha(ids), sha(decoded)))
            n, ids, decoded = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return run


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(name(doc_id).cast("long").alias("doc_id"), name(text).alias("text"))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text. ``words`` sets how many words a worker remembers (memory against time)."""
    return _input(docs, doc_id, text).mapInArrow(_encode(path, words), "doc_id long, ids array<int>")


def _decode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return run


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: decoded token ids, special tokens included."""
    rows = encoded.select(name(doc_id).cast("long").alias("doc_id"), name(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded in one pass."""
    return _input(docs, doc_id, text).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
