"""SentencePiece encoding and decoding through tables of distinct chunks.

White space becomes the marker U+2581 and every text starts with one. When no
piece of the vocabulary holds a marker behind another character, merges never
cross the place before a run of markers, so that a text is a sequence of marked
words that are segmented one by one; characters that no longer piece holds (line
ends, say) are borders too. Each task cuts the texts of a batch into such chunks,
brings the chunks down to the distinct ones, segments those its table does not
hold yet, and joins the ids back to the chunks by position. The table of a worker
outlives the batch, within a bound.

A chunk is segmented like the library does: of all neighbours whose concatenation
is a piece, the pair with the best score merges first, the leftmost of equals;
characters without a piece fall back to their bytes. The new chunks of a table are
segmented side by side, as columns of symbols and pair ranks per chunk length; a
very long chunk merges alone through a heap, so that n characters cost n log n.
The file's path is a parameter and must exist on every executor.

Cases: missing and empty texts give the end id alone; a literal U+2581 counts as
white space, as in the library; texts and chunks of any length are encoded whole;
work is per row, so that repeated rows and ties do not matter; missing ids stay
missing; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import bounded_batches, name

MARK = "▁"
# Chunks that a worker's table holds; the older half goes when there are more.
TABLE = 500_000
# Longer chunks merge alone, by a heap.
LONG = 48
# Chunks that are segmented side by side.
BLOCK = 20_000
NEVER = np.int32(2**31 - 1)
PROBES = ("", " ", "a ", "  two  blanks ", "a\nb", "▁x", "Straße \U0001f642 漢字", "hahaha 1234567", "\x00", "ﬁ 　x", "é")


class Pieces:
    """The vocabulary of a model file and its segmentation of chunks."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(lib.get_piece_size())
        special = [lib.is_control(i) or lib.is_unknown(i) for i in kinds]
        bytes_ = [lib.is_byte(i) for i in kinds]
        self.end = lib.eos_id()
        texts = [lib.id_to_piece(i) for i in kinds]
        self.ids = {t: i for i, t in enumerate(texts) if not special[i] and not bytes_[i]}
        if any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids):
            raise ValueError(f"pieces of {path} cross the borders of words")
        # Rank 0 merges first; equal scores share a rank.
        scores = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        of_score = {s: r for r, s in enumerate(scores)}
        self.rank = {t: of_score[lib.get_score(i)] for t, i in self.ids.items() if len(t) > 1}
        self.bytes = {int(texts[i][3:5], 16): i for i in kinds if bytes_[i]}
        self.values = {i: b for b, i in self.bytes.items()}
        self.shown = [" ⁇ " if lib.is_unknown(i) else "" if special[i] else t.replace(MARK, " ") for i, t in enumerate(texts)]
        self.numbers = list(map(str, kinds))
        self.starts = [t.startswith(MARK) for t in texts]
        held = set("".join(self.rank))
        alone = "".join(c for c in "\n\t\r\v\f" if c not in held)
        self.chunks = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +").findall
        self._columns(held)
        for probe in PROBES:
            if self.encode(probe) != lib.encode(probe, add_eos=True):
                raise ValueError(f"{path} is no model of merges over texts as they are")

    def _columns(self, held: set[str]) -> None:
        """Symbols as numbers, and all pairs that merge as sorted keys with their rank and result."""
        symbols = dict(self.ids)
        for c in sorted(held):
            symbols.setdefault(c, len(self.shown) + len(symbols))
        self.width = max(symbols.values()) + 2
        self.other = self.width - 1
        self.symbol = np.full(0x110000, self.other, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[32] = self.symbol[ord(MARK)]
        found = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = symbols.get(t[:k]), symbols.get(t[k:])
                if a is not None and b is not None:
                    found[a * self.width + b] = (r, symbols[t])
        keys = sorted(found)
        self.keys = np.array([*keys, 2**62], np.int64)
        self.ranks = np.array([*(found[k][0] for k in keys), NEVER], np.int32)
        self.results = np.array([*(found[k][1] for k in keys), self.other], np.int64)

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, markers as blanks."""
        return self.chunks(" " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of every chunk."""
        out: list[list[int]] = [[]] * len(chunks)
        by_size: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            by_size.setdefault(len(c), []).append(k)
        for size, places in by_size.items():
            if size > LONG:
                for k in places:
                    out[k] = self._ids(self._by_heap(list(chunks[k].replace(" ", MARK))))
                continue
            for at in range(0, len(places), BLOCK):
                some = places[at : at + BLOCK]
                for k, ids in zip(some, self._side_by_side([chunks[k] for k in some], size)):
                    # A symbol without a piece stands for the bytes of its character.
                    out[k] = ids if ids is not None else self._ids(self._by_heap(list(chunks[k].replace(" ", MARK))))
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in ``keys``, the last one for pairs that do not merge."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _side_by_side(self, chunks: list[str], size: int) -> list[list[int] | None]:
        """Chunks of one length: a row of symbols each, merged step by step; None where a character has no piece."""
        n = len(chunks)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(n, size)
        sym = self.symbol[points]
        done: list[list[int] | None] = [None] * n
        rows = np.arange(n)
        pair = self._pairs(sym[:, :-1], sym[:, 1:])
        while True:
            ranks = self.ranks[pair]
            width = sym.shape[1]
            if width > 1:
                k = ranks.argmin(axis=1)
                still = ranks[np.arange(len(k)), k] != NEVER
            else:
                k = still = np.zeros(len(sym), bool)
            for r, ids in zip(rows[~still].tolist(), sym[~still].tolist()):
                done[r] = ids if max(ids) < len(self.shown) else None
            if not still.any():
                return done
            rows, sym, pair, k = rows[still], sym[still], pair[still], k[still]
            each = np.arange(len(k))
            merged = self.results[pair[each, k]]
            # The symbol behind the merged one goes, and with it one pair.
            keep = np.arange(width - 1)
            sym = np.take_along_axis(sym, keep + (keep > k[:, None]), 1)
            sym[each, k] = merged
            pair = np.take_along_axis(pair, keep[:-1] + (keep[:-1] >= k[:, None]), 1)
            a = each[k > 0]
            pair[a, k[a] - 1] = self._pairs(sym[a, k[a] - 1], merged[a])
            a = each[k < width - 2]
            pair[a, k[a]] = self._pairs(merged[a], sym[a, k[a] + 1])

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def _by_heap(self, parts: list[str]) -> list[str]:
        """Parts as a linked list; an entry of the heap is stale when its two parts have changed."""
        rank, n = self.rank.get, len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None]
        heapify(heap)
        while heap:
            _, k, both = heappop(heap)
            nxt = after[k]
            if not parts[k] or nxt >= n or len(parts[k]) + len(parts[nxt]) != len(both) or parts[k] + parts[nxt] != both:
                continue
            parts[k], parts[nxt] = both, ""
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if (r := rank(both + parts[far])) is not None:
                    heappush(heap, (r, k, both + parts[far]))
            if (prev := before[k]) >= 0 and (r := rank(parts[prev] + both)) is not None:
                heappush(heap, (r, prev, parts[prev] + both))
        return [p for p in parts if p]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.segment(self.cut(text)) for i in ids] + [self.end]

    def spell(self, ids: list[int]) -> str:
        """Pieces side by side, runs of bytes read as UTF-8; the first marker is still there."""
        if self.values.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.values.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            out.append(self.shown[i])
        if run:
            out.append(utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        # The first piece that is shown, or a byte, tells whether there is a marker to take off.
        first = next((i for i in ids if i in self.values or self.shown[i]), None)
        text = self.spell(ids)
        return text[1:] if first is not None and self.starts[first] else text


def utf8(data: bytes) -> str:
    """UTF-8 with a replacement character for every byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        good = data[: e.start].decode()
        return good + "�" + utf8_rest(data[e.start + 1 :])


def utf8_rest(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """Batches of whole texts through one table of distinct chunks: ids as text, and the spelled text."""

    def __init__(self, path: str, size: int | None = None):
        self.pieces, self.size = Pieces(path), size or TABLE
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.before = self.ids, self.texts

    def _fill(self, chunks: set[str]) -> None:
        """Rows for the distinct chunks that the table does not hold yet."""
        if len(self.ids) > self.size // 2:
            self.before, self.ids, self.texts = (self.ids, self.texts), {}, {}
        ids, texts = self.ids, self.texts
        missing = chunks.difference(ids)
        for c in missing.intersection(self.before[0]):
            ids[c], texts[c] = self.before[0][c], self.before[1][c]
        new = list(missing.difference(ids))
        spell, number = self.pieces.spell, self.pieces.numbers.__getitem__
        for c, found in zip(new, self.pieces.segment(new)):
            spelled = spell(found)
            ids[c] = " ".join(map(number, found))
            texts[c] = c if spelled == c else spelled

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """Ids as text, decoded text and number of ids of every text."""
        cut = [self.pieces.cut(t or "") for t in texts]
        self._fill(set().union(*cut))
        ids, text, end = self.ids.__getitem__, self.texts.__getitem__, str(self.pieces.end)
        for chunks in cut:
            joined = " ".join([*map(ids, chunks), end])
            yield joined, "".join(map(text, chunks))[1:], joined.count(" ") + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [np.fromstring(x[0], np.int32, sep=" ") for x in enc.batch(b.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=ENCODED)

    return run


def _decode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for b in batches:
            texts = [pieces.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=DECODED)

    return run


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _digests(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            done = []
            for ids, text, n in enc.batch(b.column(1).to_pylist()):
                done.append((n, _sha(ids), _sha(text)))
            n, ids, text = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=DIGESTS)

    return run


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(name(doc_id).cast("long").alias("doc_id"), name(text).alias("text"))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, the end id last."""
    return _input(docs, doc_id, text).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of any list of ids."""
    rows = encoded.select(name(doc_id).cast("long").alias("doc_id"), name(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded in one pass."""
    return _input(docs, doc_id, text).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
