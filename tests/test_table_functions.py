"""Table functions in SQL against the DataFrame functions; places of terms; pools of candidates; totals."""

import re

import pytest
from pyspark.sql import functions as F

from scholion.functions.text import sentences, tokens
from scholion.functions.words import holds_word, word_position
from scholion.operators import chunks, search, sections, table_functions, tables

TEXTS = [
    "# Top\nIntro line here, long enough.\n## A\nBody of a.\n### A1\nDeep body.\n```\n# no heading\n```\n## B\n\n# Next\n#\nlast part\n",
    "Plain text.\r\n\r\nSecond paragraph! With more? Yes. 你好。世界",
    "## First ##\n~~~\n## fenced\n~~~\r## Second\rtail", "", "   \n \t", None,
    "word " * 400 + "\n\n" + "x" * 700 + "\n" + "A sentence that is here. " * 60,
    "it's the rivers' flooded don't 日本 i",
]


@pytest.fixture(scope="module")
def docs(spark):
    table_functions.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lateral_joins_equal_functions(spark, docs):
    run = lambda q: rows(spark.sql("SELECT doc_id, t.* FROM {d}, LATERAL " + q + " AS t", d=docs))
    assert run("text_tokens(text)") == rows(docs.select("doc_id", F.posexplode(tokens(F.col("text")))))
    assert run("text_sentences(text)") == rows(docs.select("doc_id", F.posexplode(sentences(F.col("text")))))
    assert run("text_sections(text)") == rows(sections.markdown_sections(docs))
    for size, overlap in ((1000, 150), (60, 20), (300, 0)):
        assert run(f"text_chunks(text, {size}, {overlap})") == rows(chunks.chunk(docs, size, overlap))


def test_table_functions_on_empty_tables_and_literals(spark, docs):
    none = docs.filter("false")
    for f in ("text_tokens(text)", "text_sentences(text)", "text_sections(text)", "text_chunks(text, 100, 10)"):
        assert spark.sql("SELECT t.* FROM {d}, LATERAL " + f + " AS t", d=none).count() == 0
    assert [r["token"] for r in spark.sql("SELECT token FROM text_tokens('River floods and dams') ORDER BY pos").collect()] == ["river", "floods", "dams"]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM text_chunks('some text that is long enough to be a chunk', 10, 10)").collect()


def test_tokens_and_sentences_need_no_python(spark, docs):
    plan = spark.sql("EXPLAIN SELECT doc_id, t.*, s.sentence FROM {d}, LATERAL text_tokens(text) AS t, LATERAL text_sentences(text) AS s", d=docs).first()[0]
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sections_by_hand(docs):
    got = [(r["section_seq"], r["section"], r["content"]) for r in sections.markdown_sections(docs.filter("doc_id = 0")).orderBy("section_seq").collect()]
    assert got == [
        (1, "Top", "# Top\nIntro line here, long enough."), (2, "A", "## A\nBody of a."), (3, "A › A1", "### A1\nDeep body.\n```\n# no heading\n```"), (4, "B", "## B"),
        (5, "Next", "# Next\n#\nlast part"),
    ]
    got = [(r["section_seq"], r["section"], r["content"]) for r in sections.markdown_sections(docs.filter("doc_id = 2")).orderBy("section_seq").collect()]
    assert got == [(1, "First", "## First ##\n~~~\n## fenced\n~~~"), (2, "Second", "## Second\ntail")]


@pytest.mark.parametrize("text, term, want", [
    ("The Dam and the damage", "dam", 5), ("damage only", "dam", None), ("x_dam dam2 (dam)", "DAM", 13), ("über dam", "ber", None), ("a\nb c", "b c", 3), ("c++ and c", "c++", 1),
    ("a.b axb", "axb", 5), ("", "x", None), (None, "x", None), ("x", None, None), ("x", "", None), ("see \\E here", "\\E", 5), ("😀 dam", "dam", 3), ("data-base data", "data", 1),
])
def test_word_position(spark, text, term, want):
    row = spark.createDataFrame([(text, term)], "t string, w string").select(word_position(F.col("t"), F.col("w")).alias("at"), holds_word(F.col("t"), F.col("w")).alias("held")).first()
    assert (row["at"], row["held"]) == (want, want is not None)
    if text and term and want and re.fullmatch(r"\w+", term):
        assert re.search(rf"\b{re.escape(term)}\b", text, re.I).start() + 1 == want


def test_pool_of_candidates(spark):
    texts = [(n, " ".join(["river"] * (n % 4) + ["dam"] * (n % 3) + ["stone"] * (n % 7))) for n in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "river dam"), (2, "stone river"), (3, "unheard")], "query_id long, query string")
    whole = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25(docs, queries, 60, distinct_len=True).collect()}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in search.bm25(docs, queries, 3, distinct_len=True, pool=8).collect()}
    want = {}
    for q, terms in ((1, ("river", "dam")), (2, ("stone", "river"))):
        held = sorted(((-sum(t.split().count(w) for w in terms), n) for n, t in texts if any(w in t for w in terms)))[:8]
        best = sorted((-whole[q, n], n) for _, n in held if whole.get((q, n), 0) > 0)[:3]
        want |= {(q, k + 1): (n, -s) for k, (s, n) in enumerate(best)}
    assert got == want


def test_totals(spark):
    df = spark.createDataFrame([("a", 2, None), ("b", 3, 1.5)], "name string, n long, x double")
    assert tables.totals(df, "rows").first().asDict() == {"rows": 2, "n": 5, "x": 1.5}
    assert tables.totals(df.filter("false"), "rows").first().asDict() == {"rows": 0, "n": 0, "x": 0.0}
