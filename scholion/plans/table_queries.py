"""Queries written as SQL text over the table functions, and places of terms; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions.words import canonical_email, location, word_position
from scholion.operators import table_functions
from scholion.operators.search import sized
from scholion.plans import material, upkeep  # noqa: F401 (their SQL is in use here)
from scholion.plans.registry import SQL, query, tok
from scholion.sources.readers import table


def _sql(spark, sf, text):
    """``text`` over ``{documents}``, with the table functions."""
    table_functions.register(spark)
    return spark.sql(text, documents=table(spark, sf, "documents"))


@query(f"WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents) SELECT doc_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM t")
def sql_tokens(spark, sf):
    return _sql(spark, sf, "SELECT doc_id, t.pos, t.token FROM {documents}, LATERAL text_tokens(text) AS t")


@query(SQL["sentences"])
def sql_sentences(spark, sf):
    return _sql(spark, sf, "SELECT doc_id, CAST(s.pos AS BIGINT) AS pos, s.sentence FROM {documents}, LATERAL text_sentences(text) AS s")


@query(SQL["markdown_sections"])
def sql_sections(spark, sf):
    return _sql(spark, sf, "SELECT doc_id, s.* FROM {documents}, LATERAL text_sections(text) AS s")


@query()
def sql_chunks(spark, sf):
    # Packing has no SQL; a test holds it against ``chunk``.
    return _sql(spark, sf, "SELECT doc_id, c.* FROM {documents}, LATERAL text_chunks(text, 1000, 150) AS c")


@query(r"""WITH p AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS term FROM benchmark), w AS (SELECT DISTINCT term FROM p),
    d AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{7,}'))) AS term FROM documents),
    m AS (SELECT doc_id, term, regexp_extract(text, '(?is)^(.*?)(?:^|[^\p{L}\p{N}_])\Q' || term || '\E(?:$|[^\p{L}\p{N}_])', 0) AS found, text FROM d JOIN w USING (term))
    SELECT doc_id, term, CASE WHEN found <> '' THEN (length(found) - length(term) - (NOT regexp_matches(found, '(?is)\Q' || term || '\E$'))::INT + 1)::INT END AS position FROM m""")
def term_positions(spark, sf):
    """The long words of benchmark items in the texts that hold their letters: where each first stands as a word, if it does."""
    letters = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{7,}"), F.lit(0)))
    wanted = table(spark, sf, "benchmark").select(F.explode(letters(F.col("text"))).alias("term")).distinct()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # Only ids meet the terms; the text of a document is joined to those it holds.
    held = docs.select("doc_id", F.explode(letters(F.col("text"))).alias("term")).join(sized(wanted), "term", "left_semi")
    return held.join(docs, "doc_id").select("doc_id", "term", word_position(F.col("text"), F.col("term")).alias("position"))


@query(r"""SELECT c_custkey, lower(trim('  ' || replace(c_name, '#', '.') || '@' || c_mktsegment || '.Example ')) AS email, CASE WHEN c_nationkey % 3 = 0 THEN 'slide ' || c_nationkey WHEN c_nationkey % 3 = 1 THEN 'page ' || c_nationkey ELSE c_mktsegment END AS location
    FROM customer""")
def contact_labels(spark, sf):
    n = F.col("c_nationkey")
    email = canonical_email(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@"), "c_mktsegment", F.lit(".Example ")))
    where = location(F.when(n % 3 == 1, n.cast("string")), F.when(n % 3 == 0, n.cast("string")), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", email.alias("email"), where.alias("location"))
