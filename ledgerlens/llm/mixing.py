"""Mixing sources to target weights by capped water-filling and seeded repetition.

``targets`` shares a budget between sources by weight; a source stops at a
multiple of its own size, and what it leaves goes to the others by weight until
none is above its cap. ``mixing_plan`` turns each target into a number of whole
repetitions and a cut on the documents' seeded hash for the fractional one, and
``taken`` reads a document's words off the plan. The plan has a row per source;
documents meet it in one join and are never shuffled by source.

Cases: a missing text has size 0; a missing source is a source of its own and
stands last; a source without words has target 0; repeated rows and rows with
equal ids share a hash and are taken alike; texts of any length are counted whole;
an empty table gives an empty plan.
Other columns pass through
whatever their names; one named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import pack, sized_broadcast, unpack, word_count

# Hex digits of the hash that make a slot: prefix sums run over 4096 slots of a
# source, then over the rows of one slot.
SLOT_DIGITS = 3


def cycle_weights(sources: DataFrame, source: str, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``_weight``: the weights in turn, sources in code point order, a missing source last."""
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn % len(weights) + 1))


def targets(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Adds ``_target`` to rows (``_size``, ``_weight``): one row per source.

    With sources in the order of cap over weight, those that reach their cap come
    first; the rest share what the capped ones leave. So one pass of running sums
    gives the level at which no source is above its cap.
    """
    cap = (F.col("_size") * max_epochs).cast("double")
    level = cap / F.col("_weight")
    before = Window.orderBy(level, F.col("_weight"), F.col("_size")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    budget = F.sum("_size").over(every).cast("double") * share
    left = budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    df = sources.select("*", cap.alias("_cap"), left.alias("_left"), weight.cast("double").alias("_open"))
    # Its share while every earlier source is at its cap; the first one below sets the level.
    df = df.withColumn("_level", F.when(F.col("_cap") * F.col("_open") >= F.col("_left") * F.col("_weight"), F.col("_left") / F.col("_open")))
    df = df.withColumn("_level", F.max("_level").over(every))
    share_of = F.when(F.col("_level").isNull() | (F.col("_cap") <= F.col("_level") * F.col("_weight")), F.col("_cap"))
    return df.withColumn("_target", share_of.otherwise(F.col("_level") * F.col("_weight"))).drop("_cap", "_left", "_open", "_level")


def seeded_hash(doc_id: str | Column, seed: str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def mixing_plan(
    sizes: DataFrame,
    doc_id: str,
    source: str,
    size: str,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """One row per source: ``_source, source_size, target, _whole, _cut, _rest_words, _at_cut``.

    Every document is taken ``_whole`` times; those whose hash is below ``_cut``
    once more; those at ``_cut`` give ``_rest_words`` of their ``_at_cut`` words. Sums run
    per slot of the hash first, so that only the rows of one slot per source are
    sorted. ``sizes`` is read twice: pass a written table, not a scan of texts.
    """
    rows = sizes.select(
        F.col(source).alias("_source"), F.col(size).cast("long").alias("_size"), seeded_hash(doc_id, seed).alias("_hash")
    ).withColumn("_slot", F.substring("_hash", 1, SLOT_DIGITS))
    slots = rows.groupBy("_source", "_slot").agg(F.sum("_size").alias("_size"))
    sources = cycle_weights(slots.groupBy("_source").agg(F.sum("_size").alias("_size")), "_source", weights)
    plan = targets(sources, share, max_epochs).select(
        "_source", F.col("_size").alias("source_size"), F.col("_target").alias("target")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole)
    plan = plan.withColumn("_extra", F.floor(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))
    wanted = plan.select(F.col("_source").alias("_of"), "_extra")
    by_slot = Window.partitionBy("_source").orderBy("_slot")
    slots = slots.withColumn("_to", F.sum("_size").over(by_slot)).withColumn("_from", F.col("_to") - F.col("_size"))
    cut_slot = (
        slots.join(wanted, F.col("_source").eqNullSafe(F.col("_of")))
        .where("_from < _extra AND _extra <= _to")
        .select("_of", "_extra", "_from", F.col("_slot").alias("_at"))
    )
    near = (
        rows.join(
            sized_broadcast(cut_slot, F.lit(128)),
            F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")),
        )
        .groupBy("_source", "_hash", "_from", "_extra")
        .agg(F.sum("_size").alias("_at_cut"))
    )
    by_hash = Window.partitionBy("_source").orderBy("_hash")
    near = near.withColumn("_till", F.col("_from") + F.sum("_at_cut").over(by_hash))
    edge = near.where("_till - _at_cut < _extra AND _extra <= _till").select(
        F.col("_source").alias("_of"),
        F.col("_hash").alias("_cut"),
        "_at_cut",
        (F.col("_extra") - F.col("_till") + F.col("_at_cut")).alias("_rest_words"),
    )
    return plan.join(edge, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of", "_extra")


def mix_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (words) and ``repetitions``.

    ``taken`` counts the words the mix takes, the document at a source's cut in
    part. ``repetitions`` is the same in whole documents: the one at the cut
    stands once more if the mix needs at least half of it.
    """
    used = {"id": doc_id, "source": source, "text": text}
    df = pack(docs, **used).withColumn("_size", word_count(F.col("_text")))
    # Written once, so that the sums do not scan the texts again.
    plan = mixing_plan(cut(df.select("_id", "_source", "_size")), "_id", "_source", "_size", weights, share, max_epochs, seed)
    plan = sized_broadcast(plan.withColumnRenamed("_source", "_of"), F.lit(128) + F.coalesce(F.octet_length("_of"), F.lit(0)))
    df = df.withColumn("_hash", seeded_hash("_id", seed)).join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left")
    below, at = F.col("_hash") < F.col("_cut"), F.col("_hash") == F.col("_cut")
    part = F.when(below, F.col("_size")).when(at, F.floor(F.col("_size") * F.col("_rest_words") / F.col("_at_cut")))
    once = below | (at & (2 * F.col("_rest_words") >= F.col("_at_cut")))
    extra = {
        "size": "_size",
        "source_size": "source_size",
        "target": "target",
        "taken": (F.col("_size") * F.col("_whole") + F.coalesce(part, F.lit(0))).cast("long"),
        "repetitions": (F.col("_whole") + F.coalesce(once.cast("int"), F.lit(0))).cast("int"),
    }
    return unpack(df, docs.columns, used, extra)


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``repetitions`` says, columns unchanged."""
    used = {"id": doc_id, "source": source, "text": text}
    df = pack(docs, **used)
    packed = mix_documents(df, "_id", "_source", "_text", **how)
    packed = packed.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("repetitions"))))
    return unpack(packed, docs.columns, used, {})
