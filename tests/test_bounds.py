"""What a Python worker holds does not grow with the batches that it gets, and texts of all documents are not shuffled for a few."""

import pyarrow as pa

from scholion.functions import batches
from scholion.llm import langid
from scholion.operators import ingest, quiz, search, terms


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_come_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(search, "WORDS", 10)
    texts = [["cats"] * 4, [], ["cats", "running"] * 3, ["dogs"] * 50, ["cat"] * 7]
    batch = pa.record_batch({"id": pa.array(range(5)), "_t": pa.array(texts, pa.list_(pa.string()))})
    pieces = list(search._stemmed(iter([batch]), 1))
    assert [p.column(0).to_pylist() for p, _ in pieces] == [[0, 1, 2], [3], [4]]
    assert [words for _, of in pieces for words in of] == [["cat"] * 4, [], ["cat", "run"] * 3, ["dog"] * 50, ["cat"] * 7]


def test_texts_meet_queries_in_one_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(n, " ".join(f"word{(n * k) % 13} tail{n % 5}" for k in range(9))) for n in range(60)] + [(60, None), (61, "the of")], "doc_id long, text string")
    asked = search.embed(spark.createDataFrame([(1, "word3 tail2"), (2, "word5 word7"), (3, "")], "doc_id long, text string"))
    want = {tuple(r) for r in search.sparse_cosine(search.embed(docs), asked, 4).collect()}
    found = search.text_cosine(docs, asked, 4)
    assert plan_of(found).count("MapInArrow") == 1
    assert len(want) == 8 and {tuple(r) for r in found.collect()} == want
    monkeypatch.setattr(search, "QUERY_ROWS", 1)
    monkeypatch.setattr(search, "DENSE_ROWS", 7)
    assert {tuple(r) for r in search.text_cosine(docs, asked, 4).collect()} == want


def test_sentences_are_cut_and_patterns_tried_once(spark):
    docs = spark.createDataFrame([(1, "s", "Heaps are trees that keep the least of their keys on top of all. A heap is a tree for queues of urgent work.")], "doc_id long, source string, text string")
    ranked = spark.createDataFrame([("s", 1, "queues"), ("s", 2, "trees"), ("s", 3, "heaps")], "source string, rank long, term string")
    found = quiz.term_sentences(docs, ranked, "source")
    assert "posexplode(pieces" not in plan_of(found)
    assert {(r["pos"], r["term"], r["pieces"][r["at"]]) for r in found.collect()} == {(0, "trees", "trees"), (1, "queues", "queues")}
    defined = terms.definitions(docs)
    assert plan_of(defined).count("is defined as") <= 3
    assert sorted((r["term"], r["definition"]) for r in defined.collect()) == [("Heaps", "Trees that keep the least of their keys on top of all"), ("heap", "A tree for queues of urgent work")]


def test_only_hit_texts_are_joined(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(50)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 3), (2, 3), (2, 44), (2, 99)], "query_id long, doc_id long")
    found = search.hit_texts(docs, hits)
    assert "BroadcastHashJoin" in plan_of(found) and "LeftSemi" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(3, "text 3"), (44, "text 44")]


def test_reflow_runs_once_and_bigrams_are_dealt_first(spark):
    pages = spark.createDataFrame([(1, 1, "one line that\ngoes on"), (2, 1, "")], "doc_id long, page long, text string")
    found = ingest.page_sections(pages, "doc_id", "page", "text")
    assert plan_of(found).count("ArrowEvalPython") == 1
    assert [r["content"] for r in found.collect()] == ["one line that goes on"]
    counted = search.occurrences(spark.createDataFrame([("a",), ("b",), ("a",)], "w string"), "w", 3)
    assert plan_of(counted).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan_of(counted)
    assert {tuple(r) for r in counted.collect()} == {("a", 2), ("b", 1)}


def test_batches_are_small_for_whole_texts(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("64m", f"{batches.BATCH_BYTES}b"), ("1g", f"{batches.BATCH_BYTES}b"), ("1m", "1m"), ("2048b", "2048b")):
            spark.conf.set(key, given)
            batches.bounded_batches(spark)
            assert spark.conf.get(key) == kept
        docs = spark.createDataFrame([(n, "a long text " * 10_000, "en") for n in range(200)], "doc_id long, text string, lang string").coalesce(1)
        model = langid.fit(docs)
        for made in (lambda: search._counted(docs, None), lambda: search.embed(docs), lambda: langid.predict(docs, model, ["doc_id"])):
            spark.conf.set(key, "64m")
            made()
            size = lambda found: (pa.record_batch({"n": [b.nbytes]}) for b in found)
            assert max(r["n"] for r in docs.mapInArrow(size, "n long").collect()) < 2 * batches.BATCH_BYTES
    finally:
        spark.conf.set(key, before)
