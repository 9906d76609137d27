"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter

import public_tokenizers as P
import tiktoken
from test_jaccard import brute

import corpus_pipeline
from scholion.llm import bpe, mixing


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !!", None, "src0", 8), (9002, None, None, None, None), (9003, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, "")
    left = {r["doc_id"] for r in docs.collect()}
    assert left == set(rows) - {9001, 9002, 9003} and docs.columns == columns

    docs = stages["exact_dedup"](spark, docs, "")
    last = {}
    for i in sorted(left):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i]["text"])] = i
    left = set(last.values())
    assert {r["doc_id"] for r in docs.collect()} == left and docs.columns == columns

    docs = stages["near_dedup"](spark, docs, "")
    left = {i for i, _, c in brute([(i, rows[i]["text"]) for i in left]) if i == c}
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(left) and docs.columns == columns

    counts = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    docs = stages["mixing"](spark, docs, "")
    mixed = docs.collect()
    assert Counter(r["doc_id"] for r in mixed) == counts and docs.columns == columns

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    out = stages["bpe"](spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in out) == counts
    for r in out:
        text = rows[r["doc_id"]]["text"]
        assert r["ids"] == reference.encode_ordinary(text) and r["n_bytes"] == len(text.encode())
