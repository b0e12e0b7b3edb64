"""Vectors for the two searches: which take part, and one row for each distinct one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(table: DataFrame, vec_id: str, embedding: str, zeros: bool) -> tuple[DataFrame, int]:
    """(id, v): rows with an id and a finite vector of the table's most frequent dimension; that dimension.

    ``zeros``: whether zero vectors take part.
    """
    v = F.col(embedding)
    fit = (
        F.col(vec_id).isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    if not zeros:
        fit = fit & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.coalesce(fit, F.lit(False))).select(F.col(vec_id).alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    width = common["d"] if common else 0
    return rows.filter(F.size("v") == width), width


def asked(rows: DataFrame, every: int) -> DataFrame:
    """The query set: ids that ``every`` divides."""
    return rows.filter(F.col("id") % every == 0)


def with_first_ids(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ids): the ``most`` smallest different ids of each distinct key, sorted, each as often as it comes
    but ``most`` times at most.

    Equal rows are counted first, in each task before the shuffle, so a key with a third of all rows sends a row for each id
    from each task; the rank filter also runs before the second shuffle.
    """
    counted = rows.groupBy(key, "id").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("times"))
    ranked = counted.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("n") <= most)
    lists = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("list"))
    return lists.select(key, F.flatten(F.transform("list", lambda x: F.array_repeat(x["id"], x["times"]))).alias("ids"))


def own_classes(rows: DataFrame, key: str, every: int) -> int:
    """How many distinct keys one id of the query set has at most: so many may drop out of its answers."""
    many = asked(rows, every).groupBy("id").agg(F.count_distinct(key).alias("n")).agg(F.max("n")).first()
    return many[0] or 1


def answers(found: DataFrame, per_query: int, score: str, descending: bool) -> DataFrame:
    """(q, list): of each query key the best candidates with their ids: structs of order, id and score.

    ``found``: (q, score, first, ids), some rows of each task; ``per_query`` of them hold the best ids.
    """
    by = F.desc(score) if descending else F.asc(score)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(by, "first"))).filter(
        F.col("n") <= per_query
    )
    order = -F.col(score) if descending else F.col(score)
    return best.select("q", order.alias("o"), F.explode("ids").alias("id"), score).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("o", "id", score))).alias("list")
    )


def ranked_answers(queries: DataFrame, lists: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from queries (id, q) and their lists; a query is not its own answer."""
    joined = queries.select(F.col("id").alias("query_id"), "q").join(lists, "q")
    own = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(own).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col(f"x.{score}").alias(score)
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of float64."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(rows).astype(np.float64) if rows else np.empty((0, 0))
