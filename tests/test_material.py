"""Words, chunks, gates and mined terms on small rows with known results."""

import random

import pytest
from pyspark.sql import functions as F

from scholion.functions import words as W
from scholion.operators import chunks, gates, index, terms
from scholion.plans import material


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems(spark):
    cases = {"studies": "study", "dies": "die", "classes": "class", "boxes": "box", "glass": "glass", "bus": "bus", "cats": "cat", "rated": "rate", "stopped": "stop", "falling": "fall", "ing": "ing", "sing": "sing", "bed": "bed", "x1ed": "x1ed"}
    rows = spark.createDataFrame(list(cases.items()), "w string, want string").select("w", "want", W.stem(F.col("w")).alias("got")).collect()
    assert {r["w"]: r["got"] for r in rows} == cases


def test_labels(spark):
    assert one(spark, W.keyword_tokens(F.lit("学习 rates"))) == ["学", "习", "rate", "学习"]
    assert one(spark, W.keyword_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, W.slug(F.lit(" Intro: to C++_basics "))) == "intro-to-c-basics"
    assert one(spark, W.slug(F.lit("!!"))) == "untitled"
    assert one(spark, W.clean_option(F.lit(" (b) yes "))) == "yes"
    assert one(spark, W.clean_option(F.lit("(b). yes"))) == "(b). yes"
    assert one(spark, W.clean_option(F.lit("C - maybe"))) == "maybe"
    assert [one(spark, W.truth(F.lit(x))) for x in (" YES. ", "错", "perhaps")] == ["True", "False", None]
    assert one(spark, W.safe_filename(F.lit("a/b/ c.Markdown "))) == "c.Markdown"
    assert one(spark, W.safe_filename(F.lit(""))) == "upload"
    assert one(spark, W.file_type(F.lit("c.Markdown"))) == "md"
    assert one(spark, W.embedding_text(F.lit("t"), F.lit(""), F.lit("c"))) == "t\nc"


@pytest.mark.parametrize("name,content,want", [
    ("a.doc", b"x", "legacy_type"), ("a.exe", b"x", "unsupported_type"), ("a.md", b"", "empty_file"), ("a.md", b"x" * 99, "too_large"),
    ("a.pdf", b" \n%PDF-1", None), ("a.pdf", b"<html>", "not_a_pdf"), ("a.docx", b"PK\x03\x04", None), ("a.docx", b"x", "not_an_archive"), ("a.txt", None, "empty_file"),
])
def test_file_errors(spark, name, content, want):
    df = spark.createDataFrame([(name, content)], "name string, c binary")
    assert df.select(gates.file_error(F.col("name"), F.col("c"), 50)).first()[0] == want


def packed(units, size, overlap):
    """Brute force: a list of open parts."""
    out, cur = [], []
    for u in units:
        if cur and len("\n".join([*cur, u])) > size:
            out.append("\n".join(cur))
            tail = []
            for p in reversed(cur):
                if overlap <= 0 or len("\n".join([p, *tail])) > overlap:
                    break
                tail = [p, *tail]
            cur = tail
        cur.append(u)
    return out + (["\n".join(cur)] if cur else [])


def test_packing_equals_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        size = rng.randint(5, 60)
        parts = ["x" * rng.randint(1, size) for _ in range(rng.randint(0, 12))]
        overlap = rng.randint(0, size - 1)
        assert chunks.pack(parts, size, overlap) == packed(parts, size, overlap)


def test_chunks_keep_every_word(spark):
    text = "Intro line.\n\n" + " ".join(f"word{n} ends here." for n in range(80)) + "\n\n" + "z" * 130
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "  ", 0), (4, "tiny", 0), (5, "one short section of text", 0)], "doc_id long, text string, content int")
    out = chunks.chunk(docs, 60, 10).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in out if r["doc_id"] == 1]
    assert [r["chunk_index"] for r in mine] == list(range(len(mine)))
    assert all(f"word{n} " in " ".join(r["content"] for r in mine) for n in range(80))
    assert max(r["char_count"] for r in mine) <= 71
    assert {r["doc_id"] for r in out} == {1, 5}
    with pytest.raises(ValueError):
        chunks.chunk(docs, 10, 10)


def test_definitions_and_sentences(spark):
    text = "- A tensor is a block of numbers with axes. It is a thing that nobody names here. Recall: the share of relevant items that were found. Models are trained by many people every day. A Tensor is another kind of thing again."
    rows = terms.definitions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert {(r["term"], r["definition"]) for r in rows} == {("tensor", "A block of numbers with axes"), ("Recall", "The share of relevant items that were found")}
    assert one(spark, terms.good_sentence(F.lit("This sentence has more than six words in it."))) is True
    assert one(spark, terms.good_sentence(F.lit("12345678901234567890 of 1234567890 is 12 or 13."))) is False


def test_chunks_query_reads_its_table(spark):
    assert material.chunks(spark, "/root/testdata/sf0.001").count() > 0


def test_study_sample_takes_turns(spark):
    rows = [("s", d, c, 300) for d in (1, 2, 3) for c in range(d * 4)] + [("t", 9, 0, 5)]
    out = index.study_sample(spark.createDataFrame(rows, "scope string, doc_id long, chunk_index long, char_count long"), "scope", 6).collect()
    mine = sorted((r["position"], r["doc_id"], r["chunk_index"]) for r in out if r["scope"] == "s")
    assert [d for _, d, _ in mine] == [1, 2, 3, 1, 2, 3]
    assert [c for _, d, c in mine if d == 3] == [0, 6]
    assert [r["doc_id"] for r in out if r["scope"] == "t"] == [9]


def test_answers_quote_what_shares_rare_words(spark):
    docs = spark.createDataFrame([(1, "Gradients vanish in very deep networks of this kind. Bananas are yellow when they are quite ripe."), (2, "It prevents gradients from vanishing in all deep networks.")], "doc_id long, text string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 1, 2)], "query_id long, rank long, doc_id long")
    asked = spark.createDataFrame([(7, "why do gradients vanish"), (8, "bananas")], "query_id long, query string")
    out = terms.answers(hits, docs, asked).collect()
    assert [(r["query_id"], r["source_rank"], r["line"]) for r in out] == [(7, 1, "Gradients vanish in very deep networks of this kind.")]
