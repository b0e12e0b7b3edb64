"""What several operators share: settings, tables, bounded joins, ordered scans, label samples."""

from __future__ import annotations

import ctypes
import functools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.session import checkpoint_folder

SETTINGS = {
    # whole texts travel in these batches; rows of any length stay within a worker's memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
#: A table of at most this many short rows may be broadcast.
BROADCAST_ROWS = 100_000
#: A table of single longs of at most this many rows (16 MB) may be broadcast.
BROADCAST_IDS = 2_000_000
HELD_OUT_OF = 5
#: Tasks that prepare a sample of labelled texts.
SAMPLE_PARTS = 24


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] | None = None


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    if _made is not None:
        _made.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def recorded(folders: list[str]) -> Iterator[None]:
    """Note in ``folders`` what ``written`` makes meanwhile, for its owner to remove."""
    global _made
    outer, _made = _made, folders
    try:
        yield
    finally:
        _made = outer


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that no helper column can clash with a column of the input."""
    return F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: Sequence[str], row: str = "row", **new: Column) -> DataFrame:
    """The packed columns again, and ``new`` ones; a new column replaces one of the same name."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"{row}.{_quoted(c)}").alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, with a broadcast hint only where its rows have been counted as few."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def batches(source: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[list[list]]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in source:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def hand_back() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not everywhere there is this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that hands its memory back to the system at its end, as its worker lives on."""

    @functools.wraps(fn)
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(source)
        hand_back()

    return run


def ordered_scan(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), name: str = "scan",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``position`` (from 0, over all rows) and ``before_<c>`` (sum of ``c`` over the rows before).

    Two levels: rows are dealt out by ranges of the order and written, so that the ranges stay as they
    are; then one short row for each range is summed up, and each range is scanned on its own.
    No task sees more than one range. Rows that are equal in ``order`` stay together.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(packed(df), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    by = [F.col(f"o{i}").asc_nulls_last() for i in range(len(order))]
    ranged = written(
        keyed.repartitionByRange(partitions, *by).withColumn("part", F.spark_partition_id()), name
    )
    totals = ranged.groupBy("part").agg(
        F.count("*").alias("n"), *[F.sum(f"row.{_quoted(c)}").alias(f"s{i}") for i, c in enumerate(sums)]
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"),
        *[F.coalesce(F.sum(f"s{i}").over(ahead), F.lit(0)).alias(f"z{i}") for i in range(len(sums))],
    )
    here = Window.partitionBy("part").orderBy(*by)
    prior = here.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "part")
    new = {"position": F.col("n0") + F.row_number().over(here) - 1} | {
        f"before_{c}": F.col(f"z{i}") + F.coalesce(F.sum(f"row.{_quoted(c)}").over(prior), F.lit(0))
        for i, c in enumerate(sums)
    }
    return unpacked(out, df.columns, **new)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder; such labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """Up to ``per_class`` labelled texts of each class outside the held-out fold, and the class counts.

    The sample is the labels with the smallest hash of their id, so reruns agree. A document with labels
    that disagree counts as 1 where at least half of them are 1; of texts that share an id the one with
    the smallest hash is taken. Null ids, labels and texts are left out.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull())
    rows = (
        texts.join(F.broadcast(picked), "id")  # two longs a row, ``2 * per_class`` rows
        .repartition(SAMPLE_PARTS, "id")
        .groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    )
    return rows, counts


def parts_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / each))
