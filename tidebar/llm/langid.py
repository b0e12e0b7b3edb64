"""Language of web pages (operator 7) by fusing evidence with Bayes' rule.

Evidence: the text (hashed byte trigrams, counted by language over all labelled documents), the language
the markup declares, and the address: host, domain and suffix. The text alone gives every page a first
posterior; grouped sums of it give how often a language is declared as what, and the languages of each
host. Host priors are smoothed by those of the domain, these by those of the suffix, these by all pages.
A page's own share is taken out of its host's sums before they serve as its prior.

Defined cases: a null or empty page has no text evidence, a missing declaration no markup evidence, an
unreadable or null address the prior of all pages; without any labelled text the language is null; ties
go to the language that comes first; texts of any length count whole; repeated pages are pages of their
own; an empty table gives an empty table; input columns are carried along and one with the name of an
output column is replaced.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, small, unpacked, written

DECLARED = re.compile(r"<html\b[^>]{0,2000}?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
TAG = re.compile(r"<[^>]*>")
MOST_LANGUAGES = 64


@dataclass(frozen=True)
class Settings:
    """``weight``: what one trigram counts, as neighbours overlap; ``most``: trigrams that count at most.

    ``pages`` is the number of pages that a prior of the level above is worth.
    """

    buckets: int = 1 << 16
    weight: float = 1 / 3
    most: float = 200.0
    pages: float = 5.0


def grams(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of the byte trigrams of lower-case text, white space in runs as one space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.empty(0, np.int64)
    codes = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % buckets


def gram_table(docs: DataFrame, text: str, lang: str, s: Settings) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket in each; counted over every labelled text."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages = [r[0] for r in labelled.select(lang).distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages.sort()
    place = {name: i for i, name in enumerate(languages)}

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(place), s.buckets), np.int64)
        for batch in source:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for lo in range(0, len(t), 1 << 20):
                    found = grams(t[lo : lo + (1 << 20)], s.buckets)
                    counts[place[name]] += np.bincount(found, minlength=s.buckets)
        at, bucket = np.nonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            i, j = at[lo : lo + (1 << 16)], bucket[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], ["l", "b", "n"]
            )

    parts = labelled.select(F.col(text).cast("binary").alias("t"), F.col(lang).alias("name"))
    summed = parts.mapInArrow(counted, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), s.buckets), 0.5)
    table[summed.column("l").to_numpy(), summed.column("b").to_numpy()] += summed.column("n").to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return markup.unescape(TAG.sub(" ", HIDDEN.sub(" ", page or "")))


def declared(page: str | None) -> str | None:
    m = DECLARED.search(page or "")
    return m[1].lower() if m else None


def likelihood(text: str, table: np.ndarray, s: Settings) -> np.ndarray:
    """Log likelihood of each language, at most ``most`` trigrams' worth."""
    total, n = np.zeros(len(table)), 0
    raw = text.encode("utf-8", "replace")
    for lo in range(0, len(raw), 1 << 20):
        found = grams(raw[lo : lo + (1 << 20)], s.buckets)
        total += table[:, found].sum(axis=1, dtype=np.float64)
        n += len(found)
    return total / n * min(n * s.weight, s.most) if n else total


def _posterior(logs: Column) -> Column:
    """Probabilities from an array of logs."""
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def identify(
    pages: DataFrame, docs: DataFrame, url: str = "url", html: str = "html", text: str = "text", lang: str = "lang",
    settings: Settings | None = None,
) -> DataFrame:
    """Add language, probability, declared, host and text_language to ``pages``."""
    s = settings or Settings()
    languages, table = gram_table(docs, text, lang, s)
    k = len(languages)
    shipped = pages.sparkSession.sparkContext.broadcast(table)  # languages x buckets floats
    if not k:
        none = F.lit(None).cast("string")
        return unpacked(pages.select(packed(pages)), pages.columns, language=none,
                        probability=F.lit(None).cast("double"), declared=none, host=none, text_language=none)

    packs = pages.select(packed(pages), F.col(html).alias("h"), F.col(url).alias("u"))

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw = batch.column(1).to_pylist()
            logs = [likelihood(visible(p), shipped.value, s).tolist() for p in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([declared(p) for p in raw], pa.string()),
                 pa.array(logs, pa.list_(pa.float64()))],
                ["row", "u", "declared", "logs"],
            )

    schema = T.StructType([
        packs.schema["row"], T.StructField("u", T.StringType()), T.StructField("declared", T.StringType()),
        T.StructField("logs", T.ArrayType(T.DoubleType())),
    ])
    host = F.lower(F.nullif(F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split("host", r"\.")
    rows = written(
        packs.mapInArrow(read, schema).withColumn("host", host)
        .withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))
        .withColumn("suffix", F.element_at(labels, -1))
        .withColumn("first", _posterior(F.col("logs"))),
        "pages",
    )
    langs = range(k)

    def sums(by: str) -> DataFrame:
        return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(
            F.count("*").alias("n"), F.array(*[F.sum(F.col("first")[i]) for i in langs]).alias("sums")
        )

    def smoothed(n: Column, found: Column, above: Column) -> Column:
        return F.transform(found, lambda x, i: (x + s.pages * F.get(above, i)) / (n + s.pages))

    whole = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("first")[i]).alias(f"s{i}") for i in langs]).first()
    overall = [((whole[f"s{i}"] or 0.0) + 1) / (whole["n"] + k) for i in langs]
    everywhere = F.array(*[F.lit(x) for x in overall])

    suffixes = written(sums("suffix").select("suffix", smoothed(F.col("n"), F.col("sums"), everywhere).alias("suffix_prior")), "suffixes")
    domains = sums("domain").withColumn("suffix", F.element_at(F.split("domain", r"\."), -1)).join(small(suffixes), "suffix", "left").select(
        "domain", smoothed(F.col("n"), F.col("sums"), F.coalesce("suffix_prior", everywhere)).alias("domain_prior")
    )
    domains = written(domains, "domains")
    parts = F.split("host", r"\.")
    hosts = (
        sums("host").withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "."))
        .join(small(domains), "domain", "left")
        .select("host", F.col("n").alias("host_n"), F.col("sums").alias("host_sums"), F.coalesce("domain_prior", everywhere).alias("domain_prior"))
    )
    hosts = written(hosts, "hosts")
    # how a language is declared: P(declared | language), smoothed by how often that is declared at all
    declarations = written(
        sums("declared").select(
            "declared",
            F.array(*[
                (F.col("sums")[i] + s.pages * F.col("n") / F.lit(float(max(1, whole["n"])))) / F.lit((whole[f"s{i}"] or 0.0) + s.pages)
                for i in langs
            ]).alias("declared_likelihood"),
        ),
        "declarations",
    )
    joined = rows.join(small(hosts), "host", "left").join(small(declarations), "declared", "left")
    # the page's own share leaves its host's sums
    rest = F.zip_with("host_sums", "first", lambda x, own: F.greatest(x - own, F.lit(0.0)))
    prior = F.coalesce(smoothed(F.col("host_n") - 1, rest, F.col("domain_prior")), everywhere)
    evidence = F.coalesce("declared_likelihood", F.array(*[F.lit(1.0)] * k))
    logs = F.transform(
        "logs", lambda x, i: x + F.log(F.greatest(F.get("prior", i), F.lit(1e-12))) + F.log(F.greatest(F.get("evidence", i), F.lit(1e-12)))
    )
    fused = joined.withColumn("prior", prior).withColumn("evidence", evidence).withColumn("posterior", _posterior(logs))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    text_best = F.array_position("first", F.array_max("first")).cast("int")
    return unpacked(
        fused, pages.columns, language=F.element_at(names, best), probability=F.array_max("posterior"),
        declared=F.col("declared"), host=F.col("host"), text_language=F.element_at(names, text_best),
    )
