"""Columns of any name pass through mixing, language ID and the pipeline's stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scholion.llm import langid, mixing

NAMES = ["_u", "_k", "_n", "_id", "_key", "_row", "_rate", "_cdf", "_source", "_order", "_copy", "rate", "copy", "rate_", "score", "lang_pred", "held_out", "_letter", "letter", "c0", "c1", "_keep", "_s", "_r", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for n, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(n))
    return df


def test_mixing(docs):
    plain = mixing.mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "rate__", "copy_"]
    rows = got.collect()
    assert sorted((r["doc_id"], r["rate__"], r["copy_"]) for r in rows) == sorted((r["doc_id"], r["rate"], r["copy"]) for r in plain.collect())
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)


def test_language_id(docs):
    plain = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(docs.select("doc_id", "text", "lang")).collect()}
    got = langid.identify(docs, keep=docs.columns)
    assert got.columns == [*docs.columns, "lang_pred_", "score_", "held_out_"]
    rows = got.collect()
    assert {r["doc_id"]: (r["lang_pred_"], r["score_"], r["held_out_"]) for r in rows} == plain
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, stage):
    few = docs.select("doc_id", "text", "lang", "source", "n_chars", *[n for n in NAMES if n != "a.b"])
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = run(spark, few, "").collect()
    plain = run(spark, few.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain)
    assert all(r["_u"] == 0 and r["_keep"] == NAMES.index("_keep") for r in rows)
