"""Searches ask with whole benchmark items, in Spark and in their SQL."""

import duckdb
import pytest

from scholion.plans import material, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["bm25_topk", "bm25_distinct_len_topk", "sparse_cosine_topk", "rrf_hybrid", "query_confidence", "eval_metrics", "extractive_answers", "search_output_rows", "abstention"]


def rounded(rows):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)


def test_queries_are_whole_items(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r["query_id"]: r["query"] for r in registry._benchmark(spark, SF).collect()} == items
    assert max(len(t.split()) for t in items.values()) > 8


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_of_whole_items(spark, name):
    con, sql = duckdb.connect(), registry.SQL[name]
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(sql)
    mine = registry.QUERIES[name](spark, SF).select(*theirs.columns)
    assert rounded(map(tuple, mine.collect())) == rounded(theirs.fetchall())
