"""Topic shares of token documents, with documents in blocks and the topics as a distributed table.

Every token has a weight in each topic and every document a share of each. A round
gives the occurrences of a token in a document to the topics in proportion to share
times weight; the totals per document and per token are the next shares and weights.
Weights start from hashes of the tokens, so that no round depends on the order of rows.

The documents of a task are packed into blocks of bounded size, which number their own
tokens and stay where they are. A round sends a block one row for each of its tokens,
the weights, and gets one back, the block's part of the token's totals, however often
the block holds the token. Documents have their shares in their block. The first round
needs no totals: shares are equal, so a token's weights follow from its start weights
and its number of occurrences. Nothing but the totals of the topics, one number each,
is known to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut, discard, scratch
from .sampling import hash_unit

# Added to the occurrences of a topic in a document, and of a token in a topic.
DOC_PRIOR, TOKEN_PRIOR = 0.1, 0.01
# A block is closed once it holds so many (document, token) pairs; its documents come in pieces of about so many tokens.
PAIRS_PER_BLOCK, TOKENS_PER_PIECE = 1 << 24, 1 << 20
# Tokens of a block in one row.
TOKENS_PER_ROW = 100_000
# Blocks are numbered by task and turn, documents by block and place.
TURNS, PLACES = 12, 26


def start_weight(token: str, topic: int, seed: int) -> Column:
    return 0.5 + hash_unit(F.concat(c(token), F.lit(f":{topic}")), seed)


def _parts(lists: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of lists with about ``most`` elements, one list at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _pack(pairs_per_block: int, tokens_per_piece: int):
    """Rows of pieces (documents with their tokens as numbers) and, at the end of a block, of its tokens and their totals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << TURNS
        number: dict[str, int] = {}
        docs = pairs = 0
        sums = np.zeros(0)
        ids_type = pa.null()

        def row(**has) -> pa.RecordBatch:
            types = {"block": pa.int64(), "first": pa.int32(), "ids": pa.list_(ids_type), "lens": pa.binary(), "words": pa.binary(), "times": pa.binary(), "tokens": pa.list_(pa.string()), "sums": pa.list_(pa.int64())}
            arrays = [has[n] if isinstance(has.get(n), pa.Array) else pa.array([has.get(n)], t) for n, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*types.items()]))

        def vocabulary() -> Iterator[pa.RecordBatch]:
            tokens = list(number)
            for a in range(0, len(tokens), TOKENS_PER_ROW):
                b = a + TOKENS_PER_ROW
                yield row(block=block, first=a, tokens=tokens[a:b], sums=sums[a:b].astype(np.int64).tolist())

        for batch in batches:
            ids_type = batch.column(0).type
            for a, b in _parts(batch.column(1), tokens_per_piece):
                ids, lists = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                flat = lists.flatten()
                doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                known = flat.is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                coded = flat.dictionary_encode()
                code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
                own = np.array([number.setdefault(t, len(number)) for t in coded.dictionary.to_pylist()], np.uint32)
                pair, n = np.unique(doc[known] * len(own) + code, return_counts=True)
                words = own[pair % len(own)]
                lens = np.bincount(pair // len(own), minlength=len(ids))
                total = np.bincount(words, n, minlength=len(number))
                total[: len(sums)] += sums
                sums = total
                times = n.astype(np.min_scalar_type(int(n.max())))
                kept = ids.filter(pa.array(lens > 0))
                lens = lens[lens > 0].astype(np.uint32)
                held = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
                yield row(block=block, first=docs, ids=held, lens=lens.tobytes(), words=words.tobytes(), times=times.tobytes())
                docs, pairs = docs + len(kept), pairs + len(words)
                if pairs >= pairs_per_block:
                    yield from vocabulary()
                    block, docs, pairs, sums = block + 1, 0, 0, np.zeros(0)
                    number.clear()
        yield from vocabulary()

    return run


def _round(k: int, first: bool, last: bool, more: bool, scale: list[float], n_tokens: int):
    """A round over one block: weights (and shares) of its rows in, totals of tokens and shares of documents out.

    The weights of a token matter in proportion only, so that they come adding up to one, without the last, as shares do.

    The ``first`` pass gets the split of a token's occurrences while shares are
    equal, and the token's total; unless there is no ``more`` to do, it goes on to the second round.
    """

    def shares(x: np.ndarray) -> np.ndarray:
        return (x + DOC_PRIOR) / (x.sum(0) + DOC_PRIOR * k)

    def run(pieces: pa.Table, rows: pa.Table) -> pa.Table:
        at, key = rows["at"].to_numpy(), rows["key"].to_numpy()
        p = np.empty((k, len(key)))
        for j in range(k - 1):
            p[j] = rows[f"p{j}"].to_numpy()
        p[k - 1] = np.maximum(1 - p[: k - 1].sum(0), 0)
        token = key >= 0
        size = int(at[token].max()) + 1
        weight = np.empty((k, size))
        weight[:, at[token]] = p[:, token]
        keys = np.empty(size, np.int64)
        keys[at[token]] = key[token]
        if first:
            split, n = weight, np.empty(size)
            n[at[token]] = rows["n"].to_numpy()[token]
            weight = (split * n + TOKEN_PRIOR) / (np.array(scale)[:, None] + TOKEN_PRIOR * n_tokens)
        else:
            share = np.empty((k, int((~token).sum())))
            share[:, at[~token]] = p[:, ~token]
        totals = np.zeros((k, 0 if last else size))
        ids, docs, found = [], [], []
        for piece in pieces.to_batches():
            for i in range(piece.num_rows):
                cell = lambda name: piece.column(name)[i]  # noqa: E731, B023
                words, lens = np.frombuffer(cell("words").as_buffer(), np.uint32), np.frombuffer(cell("lens").as_buffer(), np.uint32)
                times = cell("times").as_buffer()
                times = np.frombuffer(times, f"u{times.size // len(words)}").astype(float)
                starts = np.concatenate([[0], np.cumsum(lens[:-1], dtype=np.int64)])
                place = cell("first").as_py() + np.arange(len(lens))
                if first:
                    s = shares(np.stack([np.add.reduceat(times * split[j][words], starts) for j in range(k)]))
                else:
                    s = share[:, place]
                if more:
                    fit = [np.repeat(s[j], lens) * weight[j][words] for j in range(k)]
                    times /= reduce(add, fit)
                    for f in fit:
                        f *= times
                    s = shares(np.stack([np.add.reduceat(f, starts) for f in fit]))
                    if not last:
                        for j, f in enumerate(fit):
                            totals[j] += np.bincount(words, f, minlength=size)
                found.append(s)
                docs.append(place)
                ids.append(cell("ids").values)
        s = np.concatenate(found, 1)
        if last:
            return pa.table([pa.chunked_array(ids), *s], [*("id", *(f"topic_{j}" for j in range(k)))])
        block = pieces["block"][0].as_py()
        out = np.concatenate([totals, s], 1)
        return pa.table([np.concatenate([keys, -1 - ((block << PLACES) | np.concatenate(docs))]), *out], [*("key", *(f"p{j}" for j in range(k)))])

    return run


def topic_shares(
    docs: DataFrame, id_col: str, tokens: str, k: int = 5, iterations: int = 10, seed: int = 71, pairs_per_block: int = PAIRS_PER_BLOCK, tokens_per_piece: int = TOKENS_PER_PIECE
) -> DataFrame:
    """(id, topic_0 ..): each document's shares of the topics, which add up to one.

    ``docs`` holds lists of tokens; the lists of an id are one document. Missing ids
    and tokens are left out, and documents without a token.
    """
    spark = docs.sparkSession
    names, topics = [f"p{j}" for j in range(k)], [f"topic_{j}" for j in range(k)]
    lists = docs.where(c(id_col).isNotNull()).groupBy(c(id_col).alias("id")).agg(F.flatten(F.collect_list(c(tokens).cast("array<string>"))).alias("tokens"))
    kind = lists.schema["id"].dataType.simpleString()
    layout = f"block long, first int, ids array<{kind}>, lens binary, words binary, times binary, tokens array<string>, sums array<long>"
    path = scratch(spark, "topics")
    lists.mapInArrow(_pack(pairs_per_block, tokens_per_piece), layout).write.option("compression", "zstd").parquet(f"{path}/blocks")
    packed = spark.read.schema(layout).parquet(f"{path}/blocks")
    vocabulary = packed.where("tokens IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("tokens", "sums")).alias("_i", "_t"))
    vocabulary = vocabulary.select("block", (c("first") + c("_i")).alias("at"), F.col("_t.tokens").alias("token"), F.col("_t.sums").alias("n"))
    sizes = vocabulary.groupBy("token").agg(F.sum("n").alias("n")).select("*", *[start_weight("token", j, seed).alias(p) for j, p in enumerate(names)])
    sizes = cut(sizes.withColumn("key", F.monotonically_increasing_id()))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(p) for p in names]).first()
    n_tokens = total["n"]
    if not n_tokens or not iterations:
        ids = packed.select(F.explode("ids").alias(id_col)) if n_tokens else lists.select(c("id").alias(id_col)).limit(0)
        return ids.select(id_col, *[F.lit(1.0 / k).alias(t) for t in topics])
    vocabulary.join(sizes.select("token", "key"), "token").select("key", "block", "at").write.option("compression", "zstd").parquet(f"{path}/places")
    places = spark.read.schema("key long, block long, at int").parquet(f"{path}/places")
    n_blocks = packed.where("tokens IS NOT NULL").select("block").distinct().count()
    pieces = packed.where("words IS NOT NULL").select("block", "first", "ids", "lens", "words", "times").repartition(n_blocks, "block").persist(StorageLevel.DISK_ONLY)

    def scaled(df: DataFrame, *columns: str) -> DataFrame:
        x = [(c(p) + TOKEN_PRIOR) / (total[p] + TOKEN_PRIOR * n_tokens) for p in names]
        return df.select(*columns, *[(y / reduce(add, x)).alias(p) for p, y in zip(names, x)])

    split = scaled(sizes, "key", "n")
    total = split.agg(*[F.sum(c("n") * c(p)).alias(p) for p in names]).first()
    rows = places.join(split.drop(names[-1]), "key")
    # the first pass does two rounds, if there are two to do
    for i in range(min(2, iterations), iterations + 1):
        first, last = i <= 2, i == iterations
        step = _round(k, first, last, iterations > 1, list(total), n_tokens)
        out = pieces.groupBy("block").cogroup(rows.groupBy("block"))
        if last:
            out = cut(out.applyInArrow(step, f"id {kind}, " + ", ".join(f"{t} double" for t in topics)))
            break
        out = out.applyInArrow(step, "key long, " + ", ".join(f"{p} double" for p in names))
        sums = cut(out.groupBy("key").agg(*[F.sum(p).alias(p) for p in names]))
        total = sums.where("key >= 0").agg(*[F.sum(p).alias(p) for p in names]).first()
        weights = scaled(sums.where("key >= 0"), "key").drop(names[-1])
        own = F.lit(-1).cast("long") - c("key")
        block, at = F.shiftright(own, PLACES), own.bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int")
        rows = places.join(weights, "key").unionByName(sums.where("key < 0").select("key", block.alias("block"), at.alias("at"), *names[:-1]))
    pieces.unpersist()
    discard(spark, path)
    return out.select(c("id").alias(id_col), *topics)
