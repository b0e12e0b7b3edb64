"""Small tables with the cases that every operator must define."""

import random

from pyspark.sql import types as T

#: Names that operators use for outputs or inside; as input columns they must not clash.
CLASHING = ["row", "t", "id", "h", "s", "size", "score", "taken", "target", "fingerprint", "code", "ids", "text_", "n", "rid"]

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edge_rows(seed=1, plain=40):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(8, 60)) for _ in range(plain)]
    long = sentence(rng, 40_000, 5000)
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(texts)]
    n = len(rows)
    rows += [
        (n, texts[0], "en", "src0"), (n + 1, texts[0].upper(), "en", None),  # copies
        (n + 2, texts[1] + " w1 w2", "en", "src1"), (n + 3, None, None, "src2"), (n + 4, "", "en", "src2"),
        (n + 5, " \n\t ", "en", "src3"), (n + 6, "one", "en", "only"), (n + 7, "one two", "en", "only"),
        (n + 8, long, "en", "src0"), (n + 9, long + " end", "en", "src0"),
        (None, texts[2], "en", "src1"), (None, None, None, None), (n + 10, "über 漢字 🙂 it's\xa0x", "de", "src3"),
        (n + 11, texts[3], "en", "src1"), (n + 11, texts[3], "en", "src1"), (n + 11, texts[4], "en", "src1"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(CLASHING)) for r in rows]


def edge_docs(spark, **kw):
    return spark.createDataFrame(edge_rows(**kw), DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
