import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to wind river stone cloud house night walk seven blue paper glass run deep cold warm far".split()) + rng.choice(["", "a", "in", "ing", "s", "ed", "er", "ly"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    words = base[0].split()
    near = " ".join(words[:-2] + ["other", "end"])
    rows += [
        (20, near, "en", "s0", len(near)),
        (21, base[1].upper(), "en", "s1", len(base[1])),
        (22, base[1], "en", "s1", len(base[1])),
        (22, base[1], "en", "s1", len(base[1])),
        (23, None, None, None, None),
        (24, "", "en", "s1", 0),
        (25, " \t\n\x0b\x0c\r ", "en", "s1", 7),
        (None, base[2], "en", "s2", len(base[2])),
        (None, base[2], "en", None, len(base[2])),
        (26, "one", "en", "s1", 3),
        (27, "one", "de", "s1", 3),
        (28, "été 漢字 🙂 İ ΣΑΣ naïve\nline\n\nline", "fr", "s2", 31),
        (29, " ".join([prose(rng, 30)] * 400), "en", "s2", 1),
        (30, "x" * 50_000, "en", "s2", 50_000),
        (-5, "<|endoftext|> and <|startoftext|>", "en", "s0", 33),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns that bear internal and result names, and one with a dot."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS)
    names = "_id _text _source _host _rest _lines _hash _size _n id key uid kept size taken target n_lines bucket sigs row component_id".split()
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names), F.lit("own").alias("a.b"))
