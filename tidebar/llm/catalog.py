"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import alignment, ann, bpe, chat, divergence, langid, mixing, pagetext, pii, quality, simhash, topk, toxicity
from tidebar.llm.common import held_out, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, spaced=True, keep=["doc_id"])
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"])[0].select("doc_id", "size", "source_size", "target", "taken")


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs, keep=["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_codes(table(spark, sf_dir, "embeddings"), k=10)


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs).select("doc_id", "n_values", "text")


def quality_scores(spark: SparkSession, sf_dir: str, at_least: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= at_least).cast("int").alias("predicted"),
    )


def toxicity_scores(spark: SparkSession, sf_dir: str, at_least: float = 0.5) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= at_least).cast("int").alias("predicted"),
    )


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return langid.identify(pages, docs).select(
        "page_id", "language", "probability", "declared", "host", "text_language"
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.turns_as_messages(table(spark, sf_dir, "conversations"))
    return chat.linked(messages, chat.TURN_SCHEMAS)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5)


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pagetext.extract(pages, keep=["page_id", "url"])


def tokenizer_alignment(spark: SparkSession, sf_dir: str, files: tuple[str, str] | None = None) -> DataFrame:
    contents = []
    for path in files or map(public_tokenizers.path, ALIGNED):
        with open(path, "rb") as file:
            contents.append(file.read())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, *contents, keep=["doc_id"])


def llm_queries() -> dict:
    return {
        "op1_byte_bpe": byte_bpe,
        "op2_source_mix": source_mix,
        "op3_simhash_groups": simhash_groups,
        "op4_code_search": code_search,
        "op5_pseudonyms": pseudonyms,
        "op6_quality": quality_scores,
        "op7_page_languages": page_languages,
        "op8_tool_calls": tool_calls,
        "op9_toxicity": toxicity_scores,
        "op10_vector_search": vector_search,
        "op11_source_divergence": source_divergence,
        "op12_page_text": page_text,
        "op13_tokenizer_alignment": tokenizer_alignment,
    }


CODE_SEARCH_SQL = """
WITH rows AS (
  SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings WHERE vec_id IS NOT NULL
), bits AS (
  SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM rows
), signs AS (
  SELECT r, vec_id, i, CAST(x >= 0 AS INT) AS bit FROM bits
), pairs AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id, CAST(sum(abs(q.bit - c.bit)) AS BIGINT) AS distance
  FROM signs q JOIN signs c ON q.i = c.i
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
  GROUP BY ALL
), ranked AS (
  SELECT query_id, vec_id, distance,
         CAST(row_number() OVER (PARTITION BY qr ORDER BY distance, vec_id) AS INT) AS rank
  FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), cells AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v,
         coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS HUGEINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def llm_sql() -> dict[str, str]:
    return {"op4_code_search": CODE_SEARCH_SQL, "op11_source_divergence": DIVERGENCE_SQL}
