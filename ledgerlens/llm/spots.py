"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Words are runs of letters and digits in lower case. Wherever content words follow
a common word (an anchor), the anchor and the next ``chain`` content words form a
signature; further anchors on the way are passed over. The start of a text counts
as an anchor. A text of anchors alone has one signature, of all its words. The
fingerprint is the sorted set of 8-digit signature hashes. The likeness of two
fingerprints is the Jaccard index of their sets; two empty ones are alike (1).

Cases: a missing text counts as empty and has an empty fingerprint; equal texts
have equal fingerprints; missing ids stand below all others, in the order of
their texts' hashes; equal ids stand in the order of their texts' hashes; texts of
any length are read whole, in one row; an empty table gives an empty result. Only id and text are read. Everything is
DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import name, parts, sized_broadcast, text_bytes

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she so that the their they this to "
    "was we were which will with you "
    "als auch auf aus bei das dem den der des die ein eine einem einen er es für ich im ist mit nach nicht oder sich sie sind um "
    "und von war wie wird zu zum "
    "au aux avec ce ces dans de du elle en est et il je la le les leur ne nous ou par pas pour qu que qui sa se son sont sur un une "
    "vous "
    "al como con del el ella ha las lo los más no para pero por si sin su sus y"
).split()

# Ids that share all but their last bits meet in one task, so that a task holds at most 2^BITS distinct ids.
BITS = 11
# Buckets that one task may put in order; with more, they are ordered in groups of 2^13 first.
RING = 1_000_000


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column, anchors: Sequence[str] = tuple(ANCHORS), chain: int = 2) -> Column:
    """The fingerprint set of a text: sorted distinct 8-digit hashes."""

    def digest(c: Column) -> Column:
        return F.substring(F.md5(c.cast("binary")), 1, 8)

    def content(words: Column) -> Column:
        """Content words, each with the anchor right before it (``^`` at the start)."""

        def after(w: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            return F.struct(w.alias("w"), F.when(i == 0, F.lit("^")).when(before.isin(*anchors), before).alias("a"))

        return F.filter(F.transform(words, after), lambda x: ~x["w"].isin(*anchors))

    def chains(found: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            following = [F.get(found, i + k)["w"] for k in range(1, chain)]
            anchor = F.coalesce(x["a"], F.when(i == 0, F.lit("^")))
            return F.when(anchor.isNotNull(), digest(F.concat_ws(" ", anchor, x["w"], *following)))

        return F.sort_array(F.array_distinct(F.filter(F.transform(found, at), lambda s: s.isNotNull())))

    def of(words: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(words == "", none).otherwise(
            _bind(
                _bind(F.split(words, " "), content),
                lambda found: F.when(F.size(found) > 0, chains(found)).otherwise(F.array(digest(words))),
            )
        )

    return _bind(words_of(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets given as distinct arrays."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """(``_b``, ``_next``): the next lower bucket, the highest after the lowest."""
    n = buckets.count()
    down = Window.orderBy(F.desc("_b"))
    if n <= RING:
        top = F.max("_b").over(Window.partitionBy())
        return buckets.select("_b", F.coalesce(F.lead("_b").over(down), top).alias("_next"))
    inside = Window.partitionBy("_group").orderBy(F.desc("_b"))
    grouped = buckets.withColumn("_group", F.shiftright("_b", 13))
    tops = grouped.groupBy("_group").agg(F.max("_b").alias("_top"))
    ring = _next_bucket(tops.select(F.col("_group").alias("_b"))).select(F.col("_b").alias("_of"), F.col("_next").alias("_then"))
    ring = ring.join(tops.select(F.col("_group").alias("_then"), F.col("_top").alias("_jump")), "_then").drop("_then")
    grouped = grouped.withColumn("_next", F.lead("_b").over(inside))
    last = grouped.where("_next IS NULL").join(ring, F.col("_group") == F.col("_of")).select("_b", F.col("_jump").alias("_next"))
    return grouped.where("_next IS NOT NULL").select("_b", "_next").union(last)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _text, _sigs`` of every document with ``_next_text, _next_sigs`` of the next one by descending id, the first after the last.

    Documents meet in buckets of neighbouring ids, a bucket also getting the first
    document of the next lower bucket, so texts are shuffled once and no task sorts them all.
    """
    rows = docs.select(name(doc_id).cast("long").alias("_id"), F.coalesce(name(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    # Missing ids get places below all others, spread over many buckets.
    low = F.lit(-(1 << 62)) + F.col("_h").bitwiseAND(F.lit((1 << 40) - 1))
    rows = rows.withColumn("_o", F.coalesce("_id", low)).withColumn("_b", F.shiftright("_o", BITS))
    first = rows.groupBy("_b").agg(F.min(F.struct((-F.col("_o")).alias("o"), F.col("_h").alias("h"))).alias("_first"))
    before = _next_bucket(first.select("_b")).select(F.col("_b").alias("_to"), F.col("_next").alias("_from"))
    seams = first.join(before, F.col("_b") == F.col("_from")).select(
        F.col("_from"), "_to", (-F.col("_first.o")).alias("_so"), F.col("_first.h").alias("_sh")
    )
    seams = sized_broadcast(seams, F.lit(40))
    copies = (
        rows.join(seams, (F.col("_b") == F.col("_from")) & (F.col("_o") == F.col("_so")) & (F.col("_h") == F.col("_sh")))
        # Equal rows may all be first; one of them is enough.
        .groupBy("_to", "_o", "_h")
        .agg(F.first("_text").alias("_text"))
        .select(F.lit(None).cast("long").alias("_id"), "_text", "_h", "_o", F.col("_to").alias("_b"), F.lit(1).alias("_seam"))
    )
    n = parts(docs.sparkSession, text_bytes(docs, text))
    both = rows.select("_id", "_text", "_h", "_o", "_b", F.lit(0).alias("_seam")).unionByName(copies).repartition(n, "_b")
    both = both.withColumn("_sigs", signatures(F.col("_text")))
    down = Window.partitionBy("_b").orderBy("_seam", F.desc("_o"), "_h")
    both = both.withColumns({"_next_text": F.lead("_text").over(down), "_next_sigs": F.lead("_sigs").over(down)})
    return both.where("_seam = 0").select("_id", "_text", "_sigs", "_next_text", "_next_sigs")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``' id and text with ``sigs``, the fingerprint set."""
    return docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"), signatures(name(text)).alias("sigs"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the start of the following one."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    df = with_next(docs, doc_id, text)
    df = df.withColumn("_edited", edited(F.col("_text"), F.col("_next_text")))
    df = df.withColumn("_edited_sigs", signatures(F.col("_edited")))
    return df.select(
        F.col("_id").alias("doc_id"),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_sigs", " ").alias("fingerprint"),
        F.array_join("_edited_sigs", " ").alias("edited_fingerprint"),
        likeness(F.col("_sigs"), F.col("_edited_sigs")).alias("near_edited"),
        likeness(F.col("_sigs"), F.col("_next_sigs")).alias("near_next"),
    )


def fingerprint_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``sigs, rep, size``: documents with equal fingerprints and the smallest id among them."""
    return fingerprints(docs, doc_id, text).groupBy("sigs").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, likeness``: pairs of class representatives with a likeness of at least ``threshold``.

    Sets are partitioned by length so that a set can only match its own partition
    or the one below; in a partition two similar sets share one of their rarest
    signatures, as many as the threshold leaves open, so only those are joined.
    Equal fingerprints are one class, and empty ones match nothing.
    """
    sets = fingerprint_classes(docs, doc_id, text).where("size(sigs) > 0 AND rep IS NOT NULL")
    sets = sets.select("rep", "sigs", F.size("sigs").alias("n"))
    rows = sets.select("rep", "n", F.explode("sigs").alias("sig"))
    seen = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        rows.join(seen, "sig")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by"))
        .withColumn("open", (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
        .withColumn("part", F.floor(-F.log("n") / F.log(F.lit(threshold))).cast("int"))
        .select("rep", "n", "part", F.explode(F.slice("by", F.lit(1), F.col("open"))).alias("s"))
        .select("rep", "n", "part", F.col("s.sig").alias("sig"))
    )
    # The longer set also probes the partition below its own.
    probe = ranked.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    index = ranked.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", "part")
    pairs = index.join(probe, ["sig", "part"]).where(
        (F.col("na") >= F.col("nb") * threshold - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    )
    pairs = pairs.select("a", "b").distinct()
    one = sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
    df = pairs.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return df.where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
