import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use for columns of their own: extra columns must not clash with them.
CLASHES = ["id", "key", "block", "row", "size", "features", "quality", "pii", "encoded", "told", "u", "class_id", "target", "token"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    common = "the of and to in is that for with".split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(["er", "on", "ti", "sh", "an", "re"]) for _ in range(3)) for _ in range(n)) + "."


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows; clash=True adds columns named like operators' own."""

    def build(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASHES})
        return df

    return build


#: Null and empty texts, only spaces, ties, repeated rows, a null id, one very long text.
ODD = [(1, None), (2, ""), (3, " \t\n\v\f\r "), (4, prose(4, 60)), (4, prose(4, 60)), (5, prose(4, 60)), (None, prose(6, 40)), (7, "x" * 200_000), (8, prose(8, 30_000)), (9, "a\u00a0b \u2003c\u0085d"), (10, "é " * 30 + "😀")]
