"""The library's own operators on small rows with known results."""

import datetime as dt

from pyspark.sql import functions as F

from scholion.functions import text as X
from scholion.operators import search, study, tables
from scholion.sources.readers import deck_line
from scholion.streaming.counters import window_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_text(spark):
    assert one(spark, X.tokens(F.lit("What is the Learning rate?"))) == ["learning", "rate"]
    assert one(spark, X.tokens(F.lit("学习率A"))) == ["学", "习", "率"]
    assert one(spark, X.sentences(F.lit(" One. Two!  Three"))) == ["One.", "Two!", "Three"]
    assert one(spark, X.clean_whitespace(F.lit("a\r\n\r\n\r\n\r\nhyphen-\nated  x "))) == "a\n\nhyphenated x"
    assert one(spark, X.truncate(F.lit("alpha beta, gamma"), 13)) == "alpha beta…"
    assert one(spark, X.origin(F.lit("HTTPS://Ex.org:443/a?b"))) == "https://ex.org"
    assert one(spark, deck_line(F.lit("a\tb"), F.lit("c\nd"), F.lit("t"))) == "a b\tc d\tt"


def test_bm25_prefers_the_rare_term(spark):
    docs = spark.createDataFrame([(1, "common common word"), (2, "common rareterm"), (3, "other text")], "doc_id long, text string")
    hits = search.bm25(docs, spark.createDataFrame([(1, "common rareterm")], "query_id long, query string")).collect()
    assert [r["doc_id"] for r in sorted(hits, key=lambda r: r["rank"])] == [2, 1]


def test_fusion_order(spark):
    rows = [(1, s, d, r + 1) for s, ds in (("vector", "abc"), ("keyword", "bca")) for r, d in enumerate(ds)]
    hits = search.fuse(spark.createDataFrame(rows, "query_id long, source string, doc_id string, rank long")).collect()
    assert [r["doc_id"] for r in sorted(hits, key=lambda r: r["rank"])][0] == "b"


def test_citations_and_grading(spark):
    assert one(spark, study.citations(F.lit("x [1, 3] y [3] [2] [9] [99999999999]"), F.lit(3))) == [1, 3, 2]
    assert one(spark, study.grade_short_answer(F.lit("gradient descent minimises loss"), F.lit("loss minimises gradient descent steps"))) == 1.0
    assert one(spark, study.grade_short_answer(F.lit("bananas"), F.lit("gradient descent"))) == 0.0


def test_repetition_ladder(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    rows = [("c", at(n + 1), r) for n, r in enumerate(["good", "good", "again", "easy"])] + [("f", at(n + 1), "again") for n in range(20)]
    out = {r["card"]: r for r in study.fold_reviews(spark.createDataFrame(rows, "card string, ts timestamp, rating string"), ["card"]).collect()}
    assert (round(out["c"]["ease"], 2), out["c"]["interval_days"], out["c"]["repetitions"], out["c"]["lapses"]) == (2.06, 4.0, 1, 1)
    assert (out["f"]["ease"], out["f"]["lapses"]) == (1.3, 20)


def test_rate_windows(spark):
    rows = [(n, 1, dt.datetime(2024, 1, 1, 0, 0, n)) for n in range(5)]
    out = tables.rate_windows(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "user_id", "ts", 60, 3).collect()
    assert [r["refused"] for r in sorted(out, key=lambda r: r["event_id"])] == [False] * 3 + [True] * 2


def test_stream_counts_equal_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "events"))
    q = window_counts(stream, "user_id", "ts", 86_400).writeStream.format("memory").queryName("hits").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == batch.count()
