"""Rows that repeat an id: each goes by its own text, and of identical ones one stays."""

import tempfile

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from scholion.llm import bpe, mixing


def test_repeated_ids(spark):
    stages = dict(corpus_pipeline.STAGES)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = base.filter("n_chars > 300").orderBy("doc_id").first()["text"]
    rows = [(9101, one, "en", "a", 1), (9101, one, "en", "a", 1), (9102, "12 34 !!", "en", "a", 8), (9102, "Many words stand here and are read.", "en", "a", 35), (9103, "Only one row of this one.", "en", "a", 25)]
    rows += [(9104, "the first text of this id is shared with a later row", "en", "a", 1), (9104, "the second text of it stands alone", "en", "a", 1), (9105, "The first text of this id is shared with a later row", "en", "a", 1)]
    docs = spark.createDataFrame(rows, base.schema)

    told = stages["language_id"](spark, base.unionByName(docs), "").filter("doc_id > 9000")
    assert sorted((r["doc_id"], r["text"]) for r in told.collect()) == sorted((r[0], r[1]) for r in rows if r[1] != "12 34 !!")
    exact = stages["exact_dedup"](spark, docs, "").collect()
    gone = "the first text of this id is shared with a later row"
    assert sorted((r["doc_id"], r["text"]) for r in exact) == sorted({(r[0], r[1]) for r in rows if r[1] != gone})
    near = stages["near_dedup"](spark, docs.filter("doc_id in (9101, 9103)"), "").collect()
    assert sorted(r["doc_id"] for r in near) == [9101, 9103]


def test_run_with_null_and_repeated_ids(spark):
    """The whole pipeline over a table with null ids, ids that repeat, texts without letters and near copies."""
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, ten), (1, ten), (2, ten.upper()), (4, ten + " lambda"), (3, "123 !!"), (None, "words of a row without an id stay as they are"), (None, "words of a row without an id stay as they are"), (None, None), (7, ""), (8, "一 二 三 are words too, and letters")]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    folder = tempfile.mkdtemp(prefix="scholion-test-")
    spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], base).repartition(3).write.parquet(f"{folder}/documents.parquet")
    left = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in ((2, rows[2][1]), (None, rows[5][1]), (8, rows[9][1]))], base)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    want = sorted((str(r["doc_id"]), reference.encode_ordinary(r["text"]), len(r["text"].encode())) for r in mixing.mix(left).collect())
    got = sorted((str(r["doc_id"]), r["ids"], r["n_bytes"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and {r[0] for r in want} <= {"2", "None", "8"} and want
