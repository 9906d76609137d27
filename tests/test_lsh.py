"""Approximate neighbours: recall against the exact ranking, equal vectors, and what is left out."""

import numpy as np
import pytest

from scholion.operators import search


def recall(spark, vectors, queries, k=10, **kw):
    exact = {(r["query_id"], r["doc_id"]) for r in search.dense_cosine(vectors, queries, k).collect()}
    found = search.lsh_cosine(vectors, queries, k, **kw).collect()
    return len(exact & {(r["query_id"], r["doc_id"]) for r in found}) / len(exact), found


@pytest.mark.parametrize("bucket", [2000, 100])
def test_recall(spark, bucket):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    share, _ = recall(spark, df, df.filter("vec_id % 100 = 0"), bucket=bucket, similarity=0.35)
    assert share >= 0.9


def test_clusters_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=16)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a hot vector
    rows += [(2000, None), (2001, [float("nan")] * 16), (2002, [0.0] * 16), (2003, [1.0] * 3), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    share, found = recall(spark, df, df.filter("vec_id % 7 = 0 or vec_id = 2003"), k=5, bucket=20)
    assert share >= 0.95
    assert [(r["rank"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 7] == [(n, 999 + n) for n in range(1, 6)]
    assert not [r for r in found if r["query_id"] == 2003 or r["doc_id"] in (2000, 2001, 2002, 2003, None)]
    none = df.filter("vec_id < 0")
    assert search.lsh_cosine(none, none).count() == 0 and search.lsh_cosine(df, none).count() == 0
