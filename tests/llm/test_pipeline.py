import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import CLASHING, DOCS, edge_rows, sentence
from tests.llm.test_nearcopies import plain_groups
from tidebar.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = edge_rows()
    extra = ["x"] * len(CLASHING)
    for i in range(200, 320):
        words = sentence(rng, 60).split()
        if i % 4 == 0:
            words[5] = words[30] = "dreadful"
        if i % 10 == 1:
            words[7] = "4041894974608795"
        text = " ".join(words)
        rows.append((i, text, "en", f"src{i % 3}", len(text), *extra))
    rows += [(400 + i, rows[-i][1], "en", "src0", 1, *extra) for i in range(2, 8)]  # exact copies
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("dreadful" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        path = f"{tmp_path}/out_{name}"
        out.write.parquet(path)
        seen[name], docs = (docs.collect(), spark.read.parquet(path).collect()), spark.read.parquet(path)

    before, after = seen["toxicity"]
    gone = {(r["doc_id"], r["text"]) for r in before} - {(r["doc_id"], r["text"]) for r in after}
    bad = {(r["doc_id"], r["text"]) for r in before if "dreadful" in (r["text"] or "")}
    assert len(gone & bad) > 0.9 * len(bad) and len(gone - bad) <= 2
    before, after = seen["near_copies"]
    texts = [r["text"] for r in before]
    short = [t if len(t or "") < 100_000 else t[-2000:] for t in texts]
    groups = plain_groups(short)
    group = dict(zip(texts, groups))
    kept = [group[r["text"]] for r in after]
    assert len(kept) == len(set(kept)) and set(kept) <= set(groups) and len(set(groups)) - len(kept) <= 1  # the two long texts
    before, after = seen["pseudonyms"]
    assert len(before) == len(after) and any("4041894974608795" in (r["text"] or "") for r in before)
    assert not any("4041894974608795" in (r["text"] or "") for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
    before, after = seen["mixing"]
    times = {}
    for r in after:
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {(r["doc_id"], r["text"]) for r in before}
    before, after = seen["byte_bpe"]
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)
    assert sorted(map(tuple, (r["ids"] for r in after))) == sorted(tuple(plain.encode_ordinary(r["text"] or "")) for r in before)


def test_a_task_of_the_last_stage_has_one_worker_at_a_time(spark, tmp_path):
    """Encoding and decoding workers side by side took an executor beyond its memory; so did arrays of thousands of texts."""
    rows = [(1, "two words", "en", "a", 9), (1, "two words", "en", "a", 9), (2, "", None, "b", 0), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    out = corpus_pipeline.encoded(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 500
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r[0], r[2], r[3], plain.encode_ordinary(r[1] or "")) for r in rows]
    found = out.collect()
    assert sorted((tuple(r)[:3] + (r["ids"],) for r in found), key=str) == sorted(want, key=str)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)


def test_run_over_documents_alone(spark, tmp_path):
    docs = spark.createDataFrame([], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter(~F.col("round_trip")).count() == 0 and out.count() == 0
