"""Labelled questions to reports, exchangeable generators, deck files, samples in a budget, terms and passages."""

import hashlib
import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholion.operators import evaluation, generators, index, search, terms
from scholion.sources.readers import deck_file, questions


def test_evaluation_of_a_question_file(spark):
    base = Path(tempfile.mkdtemp(prefix="scholion-test-"))
    asked = [
        {"id": "L1", "category": "lexical", "question": "one?", "relevant": [{"file": "a.pdf", "page": 2}, {"file": "b.md", "section": "Intro"}]},
        {"id": "P1", "category": "paraphrase", "question": "two?", "relevant": [{"file": "a.pdf", "page": 9}]},
        {"id": "U1", "category": "unanswerable", "question": "none?", "relevant": []},
    ]
    (base / "q.json").write_text(json.dumps({"version": 1, "questions": asked}, indent=1))
    rows, targets = questions(spark, str(base / "q.json"))
    assert rows.count() == 3 and targets.count() == 3
    hits = spark.createDataFrame(
        [
            ("L1", "hybrid", 1, "a.pdf", 1, None), ("L1", "hybrid", 2, "b.md", None, "Intro"), ("L1", "hybrid", 3, "a.pdf", 2, "x"),
            ("L1", "keyword", 1, "a.pdf", None, "Intro"), ("L1", "keyword", 4, "a.pdf", 2, None), ("P1", "hybrid", 1, "b.md", 9, None), ("P1", "keyword", 2, "a.pdf", 9, None), ("U1", "keyword", 1, "a.pdf", 2, None),
        ],
        "query_id string, mode string, rank long, file string, page int, section string",
    )
    labelled = evaluation.relevance(hits, targets)
    assert {(r["query_id"], r["mode"], r["rank"]) for r in labelled.filter("relevant").collect()} == {("L1", "hybrid", 2), ("L1", "hybrid", 3), ("L1", "keyword", 4), ("P1", "keyword", 2)}
    ranks = evaluation.first_ranks(rows, labelled, ["hybrid", "keyword"])
    found = {(r["mode"], r["category"]): (r["n"], r["recall_1"], r["recall_3"], r["mrr"]) for r in evaluation.summary(ranks).collect()}
    assert found == {("hybrid", "all"): (2, 0.0, 0.5, 0.25), ("hybrid", "lexical"): (1, 0.0, 1.0, 0.5), ("hybrid", "paraphrase"): (1, 0.0, 0.0, 0.0), ("keyword", "all"): (2, 0.0, 0.5, 0.375), ("keyword", "lexical"): (1, 0.0, 0.0, 0.25), ("keyword", "paraphrase"): (1, 0.0, 1.0, 0.5)}
    summaries = evaluation.summary(ranks)
    assert [tuple(r)[2:] for r in evaluation.gate(summaries, 0.5).collect()] == [(0.5, True)] and not evaluation.gate(summaries, 0.9).first()["passed"]
    assert not evaluation.gate(summaries.limit(0), 0.0001).first()["passed"]
    flagged = search.abstention(spark.createDataFrame([("L1", 0.9), ("U1", 0.1)], "query_id string, best_score double"), spark.createDataFrame([("L1", True), ("P1", True), ("U1", False)], "query_id string, answerable boolean"), 0.25)
    evaluation.write_report(ranks, summaries, flagged, str(base / "report"))
    lines = [json.loads(x) for f in (base / "report/questions").glob("part-*") for x in f.read_text().splitlines()]
    assert {(x["query_id"], x["ranks"].get("hybrid"), x["ranks"].get("keyword")) for x in lines} == {("L1", 2, 4), ("P1", None, 2), ("U1", None, None)}
    evaluation.write_lines(evaluation.markdown_lines(summaries), str(base / "table"), ["position", "line"])
    text = [x for f in sorted((base / "table").glob("part-*")) for x in f.read_text().splitlines()]
    assert text == ["| Retriever | Recall@1 | Recall@3 | Recall@5 | MRR | Recall@1 (paraphrase) | MRR (paraphrase) |", "|-|-|-|-|-|-|-|", "| hybrid | 0.00 | 0.50 | 0.50 | 0.25 | 0.00 | 0.00 |", "| keyword | 0.00 | 0.50 | 1.00 | 0.38 | 0.00 | 0.50 |"]


def test_deck_files(spark):
    cards = spark.createDataFrame([("d", n, f"front\t{n}", f"back\r\n{n} ", "tag") for n in range(1, 41)] + [("e", 1, "f", "b", "t")], "deck string, position long, front string, back string, tag string")
    path = tempfile.mkdtemp(prefix="scholion-test-")
    for tag, head in ((None, ["#separator:tab", "#html:false"]), ("tag", ["#separator:tab", "#html:false", "#tags column:3"])):
        evaluation.write_lines(deck_file(cards, "deck", tag), path, ["position"], "deck")
        text = [x for f in sorted(Path(path, "deck=d").glob("part-*")) for x in f.read_text().split("\n") if x]
        assert text == [*head, *(f"front {n}\tback {n}" + ("\ttag" if tag else "") for n in range(1, 41))]


@generators.register("quiz", "good")
def good(prompts):
    body = json.dumps({"questions": [
        {"kind": "mcq", "prompt": " Which? ", "options": ["A) one", "B) two", "one"], "answer": "b", "explanation": "e", "source_id": 2},
        {"kind": "mcq", "prompt": "which?", "options": ["x", "y"], "answer": "x"},
        {"kind": "true_false", "prompt": "So?", "answer": "yes", "source_id": 9},
        {"kind": "short_answer", "prompt": "Why?", "answer": "because"},
        {"kind": "mcq", "prompt": "bad", "options": ["only"], "answer": "only"},
    ]})
    return prompts.select("quiz", F.lit(f"Here you are:\n```json\n{body}\n```").alias("raw"))


@generators.register("quiz", "odd")
def odd(prompts):
    said = {1: "no object here", 2: '{"questions": []}', 3: '{"questions": "many"}', 4: '{"other": 1}', 5: '{"questions": [{"kind": "short_answer", "prompt": "P", "answer": "A", "source_id": 1}]}'}
    table = prompts.sparkSession.createDataFrame(list(said.items()), "quiz long, raw string")
    return prompts.select("quiz").join(table, "quiz")


@generators.register("cards", "cards")
def card_maker(prompts):
    return prompts.select("quiz", F.lit('{"cards": [{"front": " F ", "back": "B", "source_id": 1}, {"front": "f", "back": "again"}, {"front": "", "back": "x"}, {"front": "G", "back": "C"}]}').alias("raw"))


def test_generators(spark):
    prompts = spark.range(1, 6).select(F.col("id").alias("quiz"))
    sources = spark.createDataFrame([(q, n, (n, f"file{n}", 0.5)) for q in range(1, 6) for n in (1, 2)], "quiz long, index int, source struct<index:int,file:string,score:double>")
    allowed = spark.createDataFrame([(1, "mcq"), (1, "true_false"), (5, "short_answer")], "quiz long, kind string")
    items, errors = generators.generated(prompts, "quiz", "good", "quiz")
    assert errors.count() == 0 and items.count() == 25
    kept = generators.accepted_questions(items, sources, allowed, "quiz", 9).orderBy("quiz", "position").collect()
    assert [(r["quiz"], r["position"], r["kind"], r["prompt"], r["answer"], r["source"] and r["source"]["file"]) for r in kept] == [(1, 1, "mcq", "Which?", "two", "file2"), (1, 2, "true_false", "So?", "True", None), (5, 1, "short_answer", "Why?", "because", None)]
    assert generators.accepted_questions(items, sources, allowed, "quiz", 1).count() == 2 and "score" not in kept[0]["source"].asDict()
    items, errors = generators.generated(prompts, "quiz", "odd", "quiz")
    assert {(r["quiz"], r["error"]) for r in errors.collect()} == {(1, "no_json"), (2, "no_items"), (3, "schema"), (4, "no_items")}
    assert [(r["quiz"], r["prompt"]) for r in items.collect()] == [(5, "P")]
    items, _ = generators.generated(prompts, "cards", "cards", "quiz")
    got = generators.accepted_cards(items, sources, "quiz", 5).filter("quiz = 2").orderBy("position").collect()
    assert [(r["position"], r["front"], r["back"], r["source"] and r["source"]["file"]) for r in got] == [(1, "F", "B", "file1"), (2, "G", "C", None)]
    with pytest.raises(ValueError, match="no generator"):
        generators.generated(prompts, "quiz", "none", "quiz")
    with pytest.raises(ValueError, match="no task"):
        generators.register("poem", "x")


@pytest.mark.parametrize(("limit", "most"), [(4, 300), (7, 2000), (3, 50)])
def test_samples_in_a_budget(spark, limit, most):
    rng = random.Random(limit)
    rows = [(s, d, i, rng.choice([30, 90, 200, 250, 400])) for s in "ab" for d in range(6) for i in range(rng.randint(1, 9))]
    got = index.study_sample(spark.createDataFrame(rows, "scope string, doc_id long, chunk_index long, char_count long"), "scope", limit, 200, most, 5)
    want = []
    for s in "ab":
        docs = {d: [(i, c) for a, e, i, c in rows if (a, e) == (s, d)] for d in range(6)}
        quota, picks = -(-limit // 6), []
        for d, chunks in docs.items():
            use = [x for x in chunks if x[1] >= 200] or chunks
            q, h = min(quota, len(use)), int(hashlib.md5(f"5:{s}:{d}".encode()).hexdigest()[:5], 16)
            picks += [(t, d, *use[(h + t * index.PARTS) * len(use) // (q * index.PARTS)]) for t in range(q)]
        taken, total = [], 0
        for _, d, i, c in sorted(picks):
            if len(taken) < limit and (not taken or total + c <= most):
                taken.append((s, len(taken) + 1, d, i))
                total += c
        want += taken
    assert sorted(tuple(r) for r in got.collect()) == want


def test_concept_terms_and_titles(spark):
    docs = spark.createDataFrame([(1, "s", "Growing pains\n\nGradient descent is an iterative method that follows the slope downwards.\n\nPlants growing and plants that grows are growing things, growing always."), (2, "s", "plants everywhere, gradients nowhere")], "doc_id long, scope string, text string")
    got = [(r["term"], r["defined"]) for r in terms.concept_terms(docs, "scope", 20).orderBy("rank").collect()]
    words = [t for t, _ in got]
    assert got[0] == ("Gradient descent", True) and sum(w in ("growing", "grows") for w in words) == 1
    hits = spark.createDataFrame([(7, 1, 1)], "query_id long, rank long, doc_id long")
    asked = spark.createDataFrame([(7, "what does gradient descent follow on the slope")], "query_id long, query string")
    line = "Gradient descent is an iterative method that follows the slope downwards."
    assert [r["line"] for r in terms.answers(hits, docs, asked).collect()] == [line]
    assert terms.answers(hits, docs.withColumn("section", F.lit(line)), asked).count() == 0


def test_containing(spark):
    docs = spark.createDataFrame([(k, f"many words about rare{k % 3} things, words about it") for k in range(60)] + [(99, "xxmany words about rare1 thingsyy"), (98, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "many words about rare1 things"), (2, "it"), (3, "words never together rare1"), (4, ""), (5, None)], "query_id long, query string")
    got = {tuple(r) for r in search.containing(docs, asked).select("query_id", "doc_id").collect()}
    assert got == {(1, k) for k in range(60) if k % 3 == 1} | {(1, 99)} | {(2, k) for k in range(60)}
