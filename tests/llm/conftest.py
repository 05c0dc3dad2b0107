import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(n, T.StringType()) for n in ("id", "sub", "size", "seed", "count", "bucket", "start", "tie", "c", "label", "x")]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents frame with extra columns whose names operators use inside."""

    def build(rows):
        full = [(i, t, lang, source, len(t) if t is not None else None, *["z"] * 11) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


WORDS = "the of and thing ation her inder over loud paper mill stone green river east north hollow bright cold seven".split()


def prose(n, seed):
    """n made-up words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(documents):
    """Nulls in every column, empty and blank texts, ties, repeated rows and a very long text."""
    long = prose(30_000, 1)
    return documents([
        (1, prose(60, 2), "en", "a"), (2, prose(60, 2), None, "b"), (3, None, "en", "a"), (4, "", "de", None), (5, " \n\t ", "de", "b"),
        (6, "One", "en", "a"), (7, "one", "en", "a"), (8, long, "fr", "c"), (9, long + " end", "fr", "c"), (None, prose(60, 2), "en", "a"),
        (None, None, None, None), (11, prose(40, 3), "en", "b"), (11, prose(40, 3), "en", "b"), (12, prose(50, 4), "es", "a"),
        (12, prose(50, 5), "es", "a"), (13, "…!? ### 12", "en", "c"), (14, prose(25, 6) + " " + prose(25, 6), "en", None),
    ])
