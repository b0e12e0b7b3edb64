"""Exact interpolated quantiles per key, without holding a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.session import cut_lineage

#: Values of a key that may be ranked together, and the share of ranks a sketch may be off by.
TOGETHER, SLACK = 20_000, 0.02
#: A sketch is asked for the values at this many even shares.
GRID = 64


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    together: int = TOGETHER) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (linear interpolation).

    A wanted rank lies in a span of values, at first all values of its key. While a span holds more than
    ``together`` of them, mergeable sketches of all such spans (one small row from each task) propose
    narrower ones; how many values lie below and inside is counted exactly, and a proposal that
    misses its rank is dropped and made wider the next time; values equal to an end of a proposal are split off. So each round divides a span by more than ten,
    whatever the size of a key, and only the values of the last spans are shuffled and ranked.
    """
    keys = list(keys)
    v = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("__v")).dropna(), "values")
    ranks = F.array(*[
        F.struct(F.lit(f"{name}_{side}").alias("name"), F.expr(rank).cast("long").alias("rank"))
        for name, p in probs.items()
        for side, rank in (("lo", f"floor({p!r}D * (__n - 1))"),
                           ("hi", f"least(floor({p!r}D * (__n - 1)) + 1, __n - 1)"))
    ])
    spans = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
    ).select("*", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__inside"), ranks.alias("__ranks"),
             F.lit(SLACK).alias("__slack"))
    spans = cut_lineage(spans, "spans")
    wide = (F.col("__inside") > together) & (F.col("__lo") < F.col("__hi"))
    while not spans.filter(wide).isEmpty():
        spans = cut_lineage(spans.filter(~wide).unionByName(_narrower(v, spans.filter(wide), keys)), "spans")
    span = [*keys, "__n", "__lo", "__hi", "__below", "__ranks"]
    counted = _inside(v, spans, keys).groupBy(*span, "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(
        Window.partitionBy(*keys, "__lo", "__hi", "__below").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("__to", F.col("__below") + upto).select(
        *keys, "__n", "__v", "__c", "__to", F.explode("__ranks").alias("__r")
    ).filter("__to - __c <= __r.rank AND __r.rank < __to")
    out = ranked.groupBy(*keys, "__n").agg(*[
        F.max(F.when(F.col("__r.name") == f"{name}_{side}", F.col("__v"))).alias(f"{name}_{side}")
        for name in probs for side in ("lo", "hi")
    ])
    return out.selectExpr(*keys, *[
        f"{n}_lo + ({p!r}D * (__n - 1) - floor({p!r}D * (__n - 1))) * ({n}_hi - {n}_lo) AS {n}"
        for n, p in probs.items()
    ])


def _inside(v: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    return v.join(spans, keys).filter("__v BETWEEN __lo AND __hi")


def _narrower(v: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """A narrower span for each rank of the given spans, or the same span with more slack."""
    one = [*keys, "__lo", "__hi"]
    sketches = _inside(v, spans, keys).groupBy(*one).agg(F.kll_sketch_agg_double("__v").alias("__sketch"))
    apart = spans.withColumn("__r", F.explode("__ranks")).withColumn("__ranks", F.array("__r"))
    place = (F.col("__r.rank") - F.col("__below") + 0.5) / F.col("__inside")

    grid = F.array(*[F.kll_sketch_get_quantile_double("__sketch", F.lit(i / GRID)) for i in range(1, GRID)])
    low, high = F.floor((place - F.col("__slack")) * GRID).cast("int"), F.ceil((place + F.col("__slack")) * GRID).cast("int")
    proposed = cut_lineage(apart.join(sketches.withColumn("__grid", grid), one).select(
        *apart.columns,
        F.when(low >= 1, F.greatest("__lo", F.get("__grid", low - 1))).otherwise(F.col("__lo")).alias("__l"),
        F.when(high < GRID, F.least("__hi", F.get("__grid", high - 1))).otherwise(F.col("__hi")).alias("__h"),
    ), "proposed")
    low_, high_ = F.col("__v") == F.col("__l"), F.col("__v") == F.col("__h")
    between = F.when((F.col("__v") > F.col("__l")) & (F.col("__v") < F.col("__h")), F.col("__v"))
    exact = v.join(proposed.select(*keys, "__l", "__h").distinct(), keys).groupBy(*keys, "__l", "__h").agg(
        F.count_if(F.col("__v") < F.col("__l")).alias("__b"),
        F.count_if(F.col("__v").between(F.col("__l"), F.col("__h"))).alias("__i"),
        F.count_if(low_).alias("__cl"), F.count_if(high_).alias("__ch"), F.min(between).alias("__ml"), F.max(between).alias("__mh"))
    known = proposed.join(exact, [*keys, "__l", "__h"])
    rank, after = F.col("__r.rank"), F.col("__b") + F.col("__i")
    found = (F.col("__b") <= rank) & (rank < after)
    at_low, at_high = rank < F.col("__b") + F.col("__cl"), rank >= after - F.col("__ch")

    def pick(name: str, low: str, high: str, inner: str) -> Column:
        """The end of the proposal that the rank lies on, or what is strictly between the ends."""
        best = F.when(at_low, F.expr(low)).when(at_high, F.expr(high)).otherwise(F.expr(inner))
        return F.when(found, best).otherwise(F.col(name)).alias(name)

    new = known.select(
        *keys, "__n", "__ranks", pick("__lo", "__l", "__h", "__ml"), pick("__hi", "__l", "__h", "__mh"),
        pick("__below", "__b", "__b + __i - __ch", "__b + __cl"), pick("__inside", "__cl", "__ch", "__i - __cl - __ch"),
        F.when(found, F.lit(SLACK)).otherwise(F.col("__slack") * 2).alias("__slack"),
    )
    # ranks that share a span go on together
    return new.groupBy(*keys, "__n", "__lo", "__hi", "__below", "__inside").agg(
        F.flatten(F.collect_list("__ranks")).alias("__ranks"), F.max("__slack").alias("__slack")).select(*spans.columns)
