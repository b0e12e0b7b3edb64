"""A training corpus from raw documents: toxic texts go, near copies go, personal data gets pseudonyms,
sources are mixed to their weights, and what stays is encoded.

Every stage takes all rows its predecessor kept, as Parquet, and returns the columns of ``documents``;
the last returns token ids. Rows with null ids or texts pass through as the operators define it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, mixing, nearcopies, pii, toxicity
from tidebar.llm.catalog import VOCABULARY
from tidebar.llm.common import hand_back, new_folder, packed, recorded, remove, table, tuned, unpacked, written

TOXIC_FROM = 0.5
#: Rows that a task reads from Parquet at once; thousands of whole texts are one array of many megabytes in an executor's heap.
READ_ROWS = "256"
_left: list[str] = []


def _stage(fn: Callable) -> Callable:
    """Remove the tables that the stage before worked with, and note those of this one.

    A stage's result is written before the next stage begins; from then on nothing reads them.
    """

    @functools.wraps(fn)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        _left.clear()
        hand_back()  # the driver's, of the sample that the stage before learned from
        with recorded(_left):
            tuned(spark).conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
            return fn(spark, docs, sf_dir)

    return begin


@_stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives under one half; it learns from the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    rows = docs.select(packed(docs, "document"), "text")
    scored = toxicity.score(rows, model, out="score")
    return unpacked(scored.filter(F.col("score") < TOXIC_FROM), docs.columns, row="document")


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Documents without words, null texts among them, are one group.
    """
    return nearcopies.without_near_copies(docs)


@_stage
def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced within their formats; ``n_chars`` follows the new text."""
    replaced = pii.pseudonymise(docs, count=None)
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents (a part counts from one half on).

    A document without words has no part in a mix and does not come back.
    """
    taken = mixing.mix(docs.select(packed(docs, "document"), "doc_id", "text", "source"), keep=["document"])[0]
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = taken.filter("size > 0").withColumn("times", times).filter("times > 0")
    repeated = copies.select("document", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return unpacked(repeated, docs.columns, row="document")


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to exactly that text.

    The ids are written in between, so that a task has one worker at a time: it encodes, or it decodes.
    """
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    texts = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    ids = bpe.encode(texts, ranks, public_tokenizers.PATTERN, spaced=True, keep=["doc_id", "lang", "source", "sha"])
    return bpe.decode(written(ids, "ids"), ranks).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_copies),
    ("pseudonyms", with_pseudonyms),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Trained scores and fingerprints are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, [before])
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
