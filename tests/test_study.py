"""Questions, cards, grading and scheduling on small hard inputs, and vectors."""

import math

import pytest
from pyspark.sql import functions as F

from scholion.functions import text
from scholion.functions import words as W
from scholion.operators import quiz, search, study, tables, upkeep

LINES = "Gradient descent moves the weights against the slope. A Gradient-based method may fail on plateaus of the loss. Momentum keeps the velocity of the earlier steps in memory. Plateaus and valleys slow plain descent down a lot."


def test_term_sentences_and_questions(spark):
    docs = spark.createDataFrame([(1, "s", LINES), (2, "s", "Momentum helps on plateaus of the loss because velocity is kept."), (3, "t", None), (4, None, "")], "doc_id long, source string, text string")
    terms = spark.createDataFrame([("s", n + 1, t) for n, t in enumerate(["plateaus", "momentum", "gradient", "velocity", "valleys", "weights", "plateau"])], "source string, rank long, term string")
    found = quiz.term_sentences(docs, terms, "source")
    rows = {r["term"]: r for r in found.collect()}
    assert set(rows) == {"plateaus", "momentum", "gradient"} and len({(r["doc_id"], r["pos"]) for r in rows.values()}) == 3
    for r in quiz.blanks(found, terms, "source").collect():
        line = rows[r["answer"]]["line"]
        assert r["prompt"].count("_____") == 1 and len(r["options"]) == len(set(r["options"])) == 4 and r["answer"] in r["options"]
        assert r["prompt"].removeprefix("Fill in the blank: ").lower().replace("_____", r["answer"]) == line.lower()
        assert not {o for o in r["options"] if o != r["answer"]} & set(line.lower().replace(".", "").split())
        assert r["answer"] != "plateaus" or "plateau" not in r["options"]
    for r in quiz.true_or_false(found, terms, "source").collect():
        assert (r["prompt"].removeprefix("True or false: ") in {x["line"] for x in rows.values()}) == (r["answer"] == "True")
    defined = spark.createDataFrame([("s", 1, "Momentum", "A memory of steps")], "source string, doc_id long, term string, definition string")
    mixed = sorted(quiz.mixed([("mcq", quiz.blanks(found, terms, "source")), ("short_answer", quiz.short_answers(defined, docs, "source"))], "source", 3).collect(), key=lambda r: r["position"])
    assert [r["kind"] for r in mixed] == ["mcq", "short_answer", "mcq"] and [r["position"] for r in mixed] == [1, 2, 3]
    cards = sorted(quiz.cards(defined, found, docs, "source", 3).collect(), key=lambda r: r["position"])
    assert cards[0]["front"] == "What is Momentum?" and all("_____" in c["front"] for c in cards[1:])
    assert quiz.term_sentences(docs.limit(0), terms, "source").count() == 0


def test_normalised_items(spark):
    rows = [("mcq", " P ", ["A) x", "(b) X", "C - y", " "], "c"), ("mcq", "P", ["x", "y"], " b) Y "), ("mcq", "P", ["x", "X"], "x"), ("mcq", "P", ["x", "y"], "d"), ("mcq", "P", None, None)]
    rows += [("true_false", "Q", [], "正确"), ("true_false", "Q", [], "maybe"), ("short_answer", "R", ["z"], " s "), ("short_answer", "R", [], " "), ("short_answer", None, [], "s")]
    got = [tuple(r) for r in quiz.normalised(spark.createDataFrame(rows, "kind string, prompt string, options array<string>, answer string").coalesce(1)).collect()]
    # The first one's letter stands for none of the two options that are left.
    assert got == [("mcq", "P", ["x", "y"], "y"), ("true_false", "Q", ["True", "False"], "True"), ("short_answer", "R", [], "s")]
    assert quiz.student_view(spark.createDataFrame([("P", "a")], "prompt string, answer string")).columns == ["prompt"]


def test_grades(spark):
    rows = [("short_answer", "Optimizers reduced losses", "The optimizer reduces the loss"), ("short_answer", " ", "x"), ("short_answer", "nothing of it", "gradient descent moves weights"), ("true_false", "Yes.", "True"), ("true_false", "maybe", "True"), ("mcq", " MOMENTUM ", "momentum"), ("mcq", None, "x")]
    got = [tuple(r["g"]) for r in spark.createDataFrame(rows, "k string, g string, c string").coalesce(1).select(study.grade(F.col("k"), F.col("g"), F.col("c")).alias("g")).collect()]
    assert got == [(1.0, "Matched 3 of 3 key terms: loss, optimizer, reduce"), (0.0, "No answer given."), (0.0, "Matched 0 of 4 key terms"), (1.0, ""), (0.0, ""), (1.0, ""), (0.0, "No answer given.")]


def test_scheduling(spark):
    rows = [(1, "2024-01-01 00:00:00", "good"), (1, "2024-01-02 00:00:00", "good"), (1, "2024-01-08 00:00:00", "hard"), (2, "2024-01-01 00:00:00", "again"), (3, "2024-01-01 00:00:00", "no such"), (4, "2024-01-01 00:00:00", None)]
    cards = study.fold_reviews(spark.createDataFrame(rows, "card long, ts string, rating string").withColumn("ts", F.to_timestamp("ts")), ["card"])
    got = {r["card"]: r for r in cards.collect()}
    ease = 2.5
    for q in (4, 4, 3):
        ease = max(1.3, round(ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 3))
    assert (got[1]["ease"], got[1]["interval_days"], got[1]["repetitions"], got[1]["reviews"]) == (ease, 7.2, 3, 3)
    assert got[1]["due_at"] - got[1]["last_reviewed_at"].timestamp() == 7.2 * 86_400
    assert got[2]["due_at"] - got[2]["last_reviewed_at"].timestamp() == 600 and got[2]["lapses"] == 1
    assert got[3]["reviews"] == got[4]["reviews"] == 0 and got[3]["ease"] == 2.5
    back = {r["card"]: r for r in study.reset_progress(cards, spark.createDataFrame([(1,)], "card long"), "card", F.lit(5.0)).collect()}
    assert (back[1]["repetitions"], back[1]["due_at"], back[1]["last_reviewed_at"]) == (0, 5.0, None) and back[2]["lapses"] == 1


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "rated ratings rate 学习 机器"), (2, ""), (3, None), (4, "the of")], "doc_id long, text string")
    rows = search.embed(docs, dim=16).collect()
    assert [r["id"] for r in rows] == [1] and math.isclose(sum(w * w for w in rows[0]["weights"]), 1)
    dense = search.densify(search.embed(docs, dim=16), 16)
    vector = dense.first()["embedding"]
    assert len(vector) == 16 and [vector[d] for d in rows[0]["dims"]] == rows[0]["weights"]
    text = dense.select(search.vector_text(F.col("embedding")).alias("t"))
    assert text.select(search.vector_of(F.col("t")).alias("v")).first()["v"] == pytest.approx(vector, abs=1e-6)
    assert search.wrong_dimension(dense, 16).count() == 0 and search.wrong_dimension(dense, 15).count() == 1
    assert search.signature("hash", "signed", 384) == "hash:signed:384"


@pytest.mark.parametrize("rows", [1, 1000])
def test_sparse_cosine_in_blocks(spark, monkeypatch, rows):
    """Blocks of queries and of texts do not change what is nearest; ties go to the smaller id."""
    monkeypatch.setattr(search, "QUERY_ROWS", rows)
    monkeypatch.setattr(search, "CELLS", 128)
    docs = spark.createDataFrame([(i, f"tree{i % 7} river{i % 3} stone") for i in range(200)], "doc_id long, text string").repartition(5)
    vectors = search.embed(docs)
    got = sorted(map(tuple, search.sparse_cosine(vectors, search.embed(docs.filter("doc_id < 4")), 3).select("query_id", "rank", "doc_id").collect()))
    assert got == [(q, n + 1, q + 21 * n) for q in range(4) for n in range(3)]


def test_relational_helpers(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    assert sorted(map(tuple, tables.counted(parents, spark.createDataFrame([(2, 5)], "k long, n long"), "k").collect())) == [(1, 0), (2, 5)]
    assert [tuple(r) for r in tables.not_in_scope(spark.createDataFrame([("a", 1), ("a", 2)], "s string, d long"), spark.createDataFrame([("a", 1), ("b", 2)], "s string, d long"), ["s", "d"]).collect()] == [("a", 2)]
    new = spark.createDataFrame([(5, "s", "x"), (6, None, "x"), (7, "s", "y")], "i long, s string, h string")
    held = spark.createDataFrame([(1, "s", "x"), (2, "s", "x"), (3, None, "x")], "i long, s string, h string")
    assert {(r["i"], r["existing"]) for r in tables.dedup_against(new, held, ["s", "h"], "i").collect()} == {(5, 1), (6, 3), (7, None)}
    assert [r["n"] for r in tables.newest(spark.createDataFrame([("s", n, n) for n in range(6)], "s string, t long, n long"), "s", "t", "n", 2, 1).orderBy("position").collect()] == [4, 3]


def test_sources_and_owners(spark):
    items = spark.createDataFrame([("q", 1), ("q", 9)], "key string, source_id int")
    sources = spark.createDataFrame([("q", 1, (7, "a", 0.5))], "key string, index int, source struct<doc_id:int,name:string,score:double>")
    assert [(r["source_id"], r["source"] and r["source"].asDict()) for r in study.with_sources(items, sources, "key").orderBy("source_id").collect()] == [(1, {"doc_id": 7, "name": "a"}), (9, None)]
    old, new = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2, 5)], "id long, owner long")
    both = upkeep.with_owner(old, new)
    assert {tuple(r) for r in both.collect()} == {(1, None), (2, 5)} and [r["id"] for r in upkeep.orphans(both, "owner").collect()] == [1]
    states = spark.createDataFrame([(1, "ready", None), (2, "failed", None), (3, "ready", "x")], "id long, status string, s string")
    assert {r["id"]: r["s"] for r in upkeep.backfilled(states, "s", F.lit("y")).collect()} == {1: "y", 2: None, 3: "x"}
    assert [r["q"] for r in study.unknown_answers(spark.createDataFrame([("z", 1), ("z", 2)], "quiz string, q long"), spark.createDataFrame([("z", 1)], "quiz string, q long"), ["quiz", "q"]).collect()] == [2]
    assert spark.createDataFrame([("ＡＢ ﬁ É",), ("Ab",), (None,)], "t string").coalesce(1).select(text.normalized(F.col("t")).alias("n")).collect() == [("ab fi é",), ("ab",), (None,)]
    with pytest.raises(ValueError):
        search.embedding_provider("none")
    docs = spark.createDataFrame([(i, f"tree number{i} stands") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "number7", "s"), (2, None, "s")], "query_id long, query string, scope string")
    sample = spark.createDataFrame([("s", n + 1, n * 2) for n in range(10)], "scope string, position long, doc_id long")
    got = search.context(asked, docs, sample, 3).collect()
    assert {r["doc_id"] for r in got if r["query_id"] == 1} == {7} and [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 2] == [0, 2, 4, 6, 8, 10, 12]


def test_both_stemmers_agree(spark):
    words = "ies ties parties classes churches boxes bus this gas dogs is ss sing king thing running stopped falling rated optimized bled used moved seed bed red ing ed agreed buzzing don't 学 x1s étés passed basis".split()
    got = [r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(W.stem(F.col("w")).alias("s")).collect()]
    assert got == [W.stem_word(w) for w in words]
