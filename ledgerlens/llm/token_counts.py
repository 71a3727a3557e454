"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. Byte-level tokens lie end to end on its
UTF-8 bytes, so running sums of their lengths give every token's character span,
and a merge of the sorted spans with the sorted section starts (an interval join)
attributes each token. Tokens that cross a border follow ``rule``:

- ``most``: the section that holds most of the token's characters, the earlier
  one of equals;
- ``start`` / ``end``: the section of the token's first / last character.

A token that holds no first byte of a character belongs to the character it
continues. Sections are the lines of the text (each with its line break), or the
named fields, joined by one line break that belongs to the field before.

Cases: a missing text or field counts as empty; an empty text has one empty
section; rows are worked on one by one, so that repeated rows, ties and other
columns do not matter; an empty table stays empty; texts are encoded whole, at any
length. Runs of white space may be as long as they like with the pattern given here;
other patterns go to the library as they are.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .bpe import SPACE
from .common import bounded_batches, name

# How byte-level vocabularies split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# The library's engine backs up through a run of white space before a word, a stack frame for each character.
LONG_RUNS = re.compile(f"[{SPACE}]{{1000,}}+")


def calm_parts(text: str) -> list[str]:
    """The text cut inside its long runs of white space, where PATTERN has a border.

    A run before anything else is one piece but for its last character, so a cut
    there changes no piece, and the part before the cut ends with the run.
    """
    cuts = [m.end() - 1 for m in LONG_RUNS.finditer(text) if m.end() < len(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


@lru_cache(maxsize=1)
def load(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary and the byte length of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def attribute(ends: np.ndarray, firsts: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a border.

    ``ends``: byte ends of the tokens; ``firsts``: characters that start in the
    first n bytes, for n from 0; ``borders``: character starts of the sections after the first.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a, b = firsts[starts], firsts[ends] - 1  # first and last character that start in the token
    a, b = np.where(b < a, a - 1, a), np.where(b < a, a - 1, b)
    low, high = np.searchsorted(borders, a, "right"), np.searchsorted(borders, b, "right")
    crosses = high > low
    if rule == "end":
        return high, crosses
    out = low.copy()
    if rule == "most":
        for i in np.flatnonzero(crosses):
            edges = [a[i], *borders[low[i] : high[i]], b[i] + 1]
            out[i] = low[i] + int(np.argmax(np.diff(edges)))
    return out, crosses


def section_counts(encode, length: np.ndarray, sections: list[str], rule: str) -> list[tuple[int, int, int, int, int]]:
    """(section, first character, characters, tokens, tokens that cross its borders) of the joined sections."""
    text = "".join(sections)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(length[encode(text)]) if text else np.zeros(0, np.int64)
    sizes = [len(s) for s in sections]
    starts = np.cumsum([0, *sizes[:-1]])
    at, crosses = attribute(ends, firsts, starts[1:], rule)
    n = np.bincount(at, minlength=len(sections))
    x = np.bincount(at[crosses], minlength=len(sections))
    return [(k, int(starts[k]), sizes[k], int(n[k]), int(x[k])) for k in range(len(sections))]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
# Bytes of text whose rows make one output batch.
BATCH = 4 << 20


def _count(path: str, pattern: str, rule: str, lines: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length = load(path, pattern)

        def encode(text: str) -> np.ndarray:
            parts = calm_parts(text) if pattern == PATTERN else [text]
            return np.concatenate([np.asarray(enc.encode_ordinary(p), np.int64) for p in parts])

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), SCHEMA.types)], schema=SCHEMA)

        for b in batches:
            held: list[tuple] = []
            size = 0
            for doc_id, *fields in zip(*(c.to_pylist() for c in b.columns)):
                if lines:
                    sections = (fields[0] or "").split("\n")
                    sections = [s + "\n" for s in sections[:-1]] + sections[-1:]
                else:
                    sections = [(f or "") + "\n" for f in fields[:-1]] + [fields[-1] or ""]
                held += [(doc_id, *r) for r in section_counts(encode, length, sections, rule)]
                size += sum(map(len, sections))
                if size > BATCH:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    return run


def count_tokens(
    docs: DataFrame, path: str, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "most", pattern: str = PATTERN
) -> DataFrame:
    """One row per document and section: ``doc_id, section, start, n_chars, n_tokens, n_crossing``.

    With one field its lines are the sections, with several the fields themselves.
    ``path`` names a file of byte-level ranks that every executor can read.
    """
    if rule not in ("most", "start", "end"):
        raise ValueError(f"unknown rule {rule}")
    bounded_batches(docs.sparkSession)
    rows = docs.select(name(doc_id).cast("long").alias("doc_id"), *(name(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return rows.mapInArrow(
        _count(path, pattern, rule, len(fields) == 1),
        "doc_id long, section int, start long, n_chars long, n_tokens long, n_crossing long",
    )
