"""Small helpers of the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# A table is sent to every executor only below this many bytes.
BROADCAST_BYTES = 32 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def sized_broadcast(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` marked for broadcast if the bytes of all its rows stay below the bound, else as it is.

    ``row_bytes`` gives the bytes of a row. The table is written once, so that asking
    for its size does not compute it twice. Without the mark, Spark shuffles both
    sides and splits hot keys while it runs.
    """
    df = cut(df)
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts; sets the number of partitions of the heavy shuffles."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """Partitions for ``size`` bytes at ``each`` bytes a partition, never below the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def crc_fold(c: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a missing value counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def name(c: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + c.replace("`", "``") + "`")


def pack(df: DataFrame, **used: str) -> DataFrame:
    """``_key`` for each used column and one struct ``_rest`` with all others, so that no name can clash."""
    rest = [c for c in df.columns if c not in used.values()]
    cols = [name(c).alias(f"_{k}") for k, c in used.items()]
    return df.select(*cols, F.struct(*map(name, rest)).alias("_rest")) if rest else df.select(*cols)


def unpack(df: DataFrame, columns: list[str], used: dict[str, str], extra: dict[str, str | Column]) -> DataFrame:
    """The columns as they were, then ``extra``; an extra column replaces one of the same name."""
    back = {c: F.col(f"_{k}") for k, c in used.items()}
    lower = {k.lower() for k in extra}
    kept = [(back[c] if c in back else F.col("_rest").getField(c)).alias(c) for c in columns if c.lower() not in lower]
    return df.select(*kept, *((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in extra.items()))


def bounded_batches(spark: SparkSession, rows: int = 256) -> SparkSession:
    """Few rows to an Arrow batch, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return spark
