"""Headline and sentiment classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.params import AVOID_WORDS, CAUTION_WORDS
from tidebar.functions.scalar import col

# fixed values: severity order of the states
STATES = {"NEUTRAL": 0, "CAUTION": 1, "AVOID": 2}


def first_word(text: Column, words: list[str]) -> Column:
    """First keyword of the list contained in the text, else NULL."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def headline_text(title: Column | str, content: Column | str) -> Column:
    """Lower-cased title and the first 200 characters of the content."""
    return F.lower(
        F.concat_ws(" ", F.coalesce(col(title), F.lit("")),
                    F.substring(F.coalesce(col(content), F.lit("")), 1, 200))
    )


def classify_headlines(df: DataFrame, text: Column, avoid=None, caution=None) -> DataFrame:
    """State and reason of each headline; AVOID words beat CAUTION words."""
    a = first_word(text, avoid or AVOID_WORDS)
    c = first_word(text, caution or CAUTION_WORDS)
    return df.withColumn(
        "news_state",
        F.when(a.isNotNull(), "AVOID").when(c.isNotNull(), "CAUTION").otherwise("NEUTRAL"),
    ).withColumn("news_word", F.coalesce(a, c))


def parse_headlines(df: DataFrame, payload: Column | str) -> DataFrame:
    """News API JSON ``{data:[{title,content}]}`` to one row per article."""
    parsed = F.from_json(col(payload), "data array<struct<title:string,content:string>>")
    return df.withColumn("a", F.explode(parsed["data"])).select(
        *df.columns, "a.title", "a.content")


def batch_state(classified: DataFrame, by: list[str], avoid=None, caution=None) -> DataFrame:
    """State of a batch of headlines: the most severe one, with the first keyword of its list.

    The keyword that counts is the earliest in the list over the whole batch, so the rank of
    each hit is reduced with ``min``, map-side.
    """
    def rank(state: str, words: list[str]) -> Column:
        m = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
        return F.min(F.when(F.col("news_state") == state, F.element_at(m, F.col("news_word"))))

    avoid, caution = avoid or AVOID_WORDS, caution or CAUTION_WORDS
    df = classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("headlines"),
        rank("AVOID", avoid).alias("_a"), rank("CAUTION", caution).alias("_c"),
    )
    a = F.get(F.array(*[F.lit(w) for w in avoid]), F.col("_a"))
    c = F.get(F.array(*[F.lit(w) for w in caution]), F.col("_c"))
    return df.select(
        *by, "headlines",
        F.when(a.isNotNull(), "AVOID").when(c.isNotNull(), "CAUTION").otherwise("NEUTRAL").alias(
            "news_state"),
        F.coalesce(a, c).alias("news_word"),
    )


def newest(df: DataFrame, by: list[str], order: str, n: int = 20) -> DataFrame:
    """The newest n headlines per batch key (the scan looks at 20).

    Ranked inside a hash slice of the key first, so that only n rows per slice meet.
    """
    part = df.withColumn("__s", F.pmod(F.xxhash64(order), F.lit(64)))
    w1 = Window.partitionBy(*by, "__s").orderBy(F.desc(order))
    w2 = Window.partitionBy(*by).orderBy(F.desc(order))
    part = part.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= n)
    return part.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= n).drop(
        "__r", "__s")


def fear_greed(df: DataFrame, value: Column | str) -> DataFrame:
    """Index banding: 20 and below or 80 and above call for caution."""
    v = col(value)
    return df.withColumn(
        "fng_state", F.when((v <= 20) | (v >= 80), "CAUTION").otherwise("NEUTRAL")
    ).withColumn(
        "fng_reason",
        F.when(v <= 20, F.concat(F.lit("Extreme Fear (FnG="), v.cast("string"), F.lit(")")))
        .when(v >= 80, F.concat(F.lit("Extreme Greed (FnG="), v.cast("string"), F.lit(")"))),
    )


def combined_sentiment(df: DataFrame, value: str = "fng_value") -> DataFrame:
    """Most severe of the two states and the reason shown for it."""
    word = F.when(F.col("news_word").isNotNull(),
                  F.concat(F.lit("keyword: '"), F.col("news_word"), F.lit("'")))
    avoid = F.col("news_state") == "AVOID"
    caution = (F.col("news_state") == "CAUTION") | (F.col("fng_state") == "CAUTION")
    state = F.when(avoid, "AVOID").when(caution, "CAUTION").otherwise("NEUTRAL")
    reason = (
        F.when(avoid, word)
        .when(caution, F.concat_ws(" | ", "fng_reason", word))
        .when(F.col(value) != 0, F.concat(F.lit("FnG="), F.col(value).cast("string")))
        .otherwise("OK")
    )
    return df.withColumn("sentiment", state).withColumn("sentiment_reason", reason)
