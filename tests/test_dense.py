"""Dense cosine against brute force, over several blocks, with ties, repeated vectors and rows that cannot be compared."""

import numpy as np

import __spark_entry__ as entry
from scholion.operators import search


def test_dense_cosine(spark):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(size=8).round(2).tolist()) for n in range(60)] + [(100 + n, [1.0] * 8) for n in range(8)]
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (None, [1.0] * 8), (203, [1.0, 2.0]), (204, [1.0, 2.1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    want = set()
    for i, v in rows + odd[4:]:
        found = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 5), j) for j, w in rows + odd[4:] if j != i and len(w) == len(v))
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:3])}
    for size in (7, 1000):
        got = {(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in search.dense_cosine(df, df, 3, block_rows=size).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in want} and all(abs(a[3] - b[3]) < 3e-5 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_registered():
    assert "dense_cosine_topk" in entry.queries() and "dense_cosine_topk" in entry.oracle_sql()
