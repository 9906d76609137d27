"""Queries over questions and cards; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import quiz, terms
from scholion.plans.material import _LINES
from scholion.plans.registry import _STEM, SQL, query
from scholion.sources.readers import table
from scholion.sources.scratch import stored

_PIECES = r"regexp_extract_all(line, '[A-Za-z][A-Za-z\-]{3,}|(?s).')"
_GOOD = r"length(line) BETWEEN 40 AND 280 AND len(regexp_extract_all(line, '[^ \t\n\r\f]+')) >= 6 AND length(regexp_replace(line, '[^0-9]', '', 'g')) < length(line) * 0.2::DOUBLE"
_STEM_T, _STEM_A = _STEM.replace("(w,", "(t,").replace("THEN w", "THEN t").replace("w LIKE", "t LIKE").replace("length(w)", "length(t)"), _STEM.replace("(w,", "(term,").replace("THEN w", "THEN term").replace("w LIKE", "term LIKE").replace("length(w)", "length(term)")
_ONE = f"""{_LINES}, kt AS MATERIALIZED ({SQL['key_terms']}), df AS MATERIALIZED (SELECT source, d.* FROM ({SQL['definitions']}) d JOIN documents USING (doc_id)),
    gl AS (SELECT source, doc_id, pos, line, {_PIECES} AS pieces FROM l JOIN documents USING (doc_id) WHERE {_GOOD}),
    gw AS (SELECT source, doc_id, pos, line, pieces, unnest(range(len(pieces))) AS plc, unnest(pieces) AS w FROM gl),
    gb AS (SELECT source, doc_id, pos, line, pieces, plc, kt.term FROM gw JOIN kt USING (source) WHERE length(w) >= 4 AND lower(w) = kt.term QUALIFY row_number() OVER (PARTITION BY source, doc_id, pos ORDER BY rank, plc) = 1),
    ts AS MATERIALIZED (SELECT *, doc_id || ':' || pos AS key FROM gb QUALIFY row_number() OVER (PARTITION BY source, term ORDER BY md5(doc_id || ':' || pos), doc_id, pos) = 1),
    pool AS (SELECT source, list_sort(list(term)) AS pool FROM kt WHERE rank <= 40 GROUP BY source),
    tp AS (SELECT ts.*, list_filter(pool, lambda t: {_STEM_T} <> {_STEM_A} AND NOT list_contains(list_transform(pieces, lambda x: lower(x)), t) AND NOT contains(term, t)) AS fine FROM ts JOIN pool USING (source))"""
_DEAL = "list_transform(list_sort(list_transform({0}, lambda t: md5({1} || ':' || t) || t)), lambda s: substr(s, 33))"
_PUT = "array_to_string(list_transform(range(len(pieces)), lambda i: CASE WHEN i = plc THEN {} ELSE pieces[i + 1] END), '')"
_BLANKS = f"""bw AS (SELECT *, {_DEAL.format('fine', 'key')}[:3] AS wrong FROM tp),
    bl AS (SELECT source, doc_id, 'Fill in the blank: ' || {_PUT.format("'_____'")} AS prompt, {_DEAL.format("list_append(wrong, term)", "key || 'o'")} AS options, term AS answer FROM bw WHERE len(wrong) = 3)"""
_TF = f"""tw AS (SELECT *, {_DEAL.format('fine', 'key')}[1] AS swap FROM tp),
    tf AS (SELECT source, doc_id, 'True or false: ' || CASE WHEN substr(md5(key), 1, 1) < '8' AND swap IS NOT NULL THEN {_PUT.format('swap')} ELSE line END AS prompt, ['True', 'False'] AS options,
        CASE WHEN substr(md5(key), 1, 1) < '8' AND swap IS NOT NULL THEN 'False' ELSE 'True' END AS answer FROM tw)"""
_SHORT = f"""hd AS (SELECT source, doc_id, heading, summary FROM documents JOIN ({SQL['first_line_heading']}) USING (doc_id) JOIN (SELECT * FROM SUMMARIES) USING (doc_id)),
    sa AS (SELECT source, doc_id, 'In your own words, what is ' || term || '?' AS prompt, []::VARCHAR[] AS options, definition AS answer FROM df
        UNION ALL SELECT source, doc_id, 'Summarize the key idea of “' || heading || '”.', [], summary FROM hd WHERE heading IS NOT NULL AND summary <> '')"""


def _with_summaries(sql: str) -> str:
    from scholion.plans import upkeep  # noqa: F401

    return sql.replace("(SELECT * FROM SUMMARIES)", f"({SQL['section_summaries']})")


def _made(spark, sf):
    docs = table(spark, sf, "documents")
    kept = stored(terms.key_terms(docs, "source", 40), "key-terms")
    return docs, kept, stored(quiz.term_sentences(docs, kept, "source"), "term-sentences"), terms.definitions(docs).join(docs.select("doc_id", "source"), "doc_id")


@query(f"WITH {_ONE}, {_BLANKS} SELECT source, doc_id, prompt, array_to_string(options, '|') AS options, answer FROM bl")
def cloze_questions(spark, sf):
    _, kept, found, _ = _made(spark, sf)
    return quiz.blanks(found, kept, "source").withColumn("options", F.array_join("options", "|"))


@query(f"WITH {_ONE}, {_TF} SELECT source, doc_id, prompt, answer FROM tf")
def true_false_questions(spark, sf):
    _, kept, found, _ = _made(spark, sf)
    return quiz.true_or_false(found, kept, "source").drop("options")


@query(_with_summaries(f"""WITH {_ONE}, {_BLANKS}, {_TF}, {_SHORT},
    ev AS (SELECT 0 AS k, 'mcq' AS kind, * FROM bl UNION ALL SELECT 1, 'true_false', * FROM tf UNION ALL SELECT 2, 'short_answer', * FROM sa),
    ou AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY source, lower(trim(prompt)) ORDER BY k, md5(prompt), doc_id) = 1), tu AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY md5(prompt), doc_id) AS turn FROM ou)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY turn, k) AS position, kind, doc_id, prompt, array_to_string(options, '|') AS options, answer FROM tu QUALIFY position <= 12"""))
def quiz_mix(spark, sf):
    docs, kept, found, defined = _made(spark, sf)
    kinds = [("mcq", quiz.blanks(found, kept, "source")), ("true_false", quiz.true_or_false(found, kept, "source")), ("short_answer", quiz.short_answers(defined, docs, "source"))]
    return quiz.mixed(kinds, "source", 12).withColumn("options", F.array_join("options", "|"))


@query(_with_summaries(f"""WITH {_ONE}, {_SHORT}, ca AS (SELECT source, 0 AS p, doc_id, 'What is ' || term || '?' AS front, definition AS back FROM df UNION ALL SELECT source, 1, doc_id, 'Fill in the blank: ' || {_PUT.format("'_____'")}, term FROM ts
        UNION ALL SELECT source, 2, doc_id, 'Key idea: ' || heading, summary FROM hd WHERE heading IS NOT NULL AND summary <> ''),
    co AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY source, lower(front) ORDER BY p, doc_id, front, back) = 1)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY p, doc_id, front) AS position, front, back FROM co QUALIFY position <= 20"""))
def flashcards(spark, sf):
    docs, _, found, defined = _made(spark, sf)
    return quiz.cards(defined, found, docs, "source", 20)


_ITEMS = r"""w AS (SELECT conv_id, turn, text, string_split(text, ' ') AS o, ['mcq', 'true_false', 'short_answer'][turn % 3 + 1] AS kind FROM conversations),
    i AS (SELECT conv_id, turn, kind, ' ' || text AS prompt, list_transform(range(1, 6), lambda n: ['A) ', '(b). ', 'C - ', '', 'd: '][n] || coalesce(o[n], '')) AS options,
        CASE kind WHEN 'mcq' THEN ['B', 'c', coalesce(o[2], '') || ' ', 'none'][conv_id % 4 + 1] WHEN 'true_false' THEN ['Yes.', 'falsch', ' F ', '对'][conv_id % 4 + 1] ELSE CASE WHEN conv_id % 4 = 0 THEN '  ' ELSE text END END AS answer FROM w),
    c AS (SELECT *, list_filter(list_transform(options, lambda x: trim(regexp_replace(x, '^[ \t\n\r\f]*(\(?[A-Da-d][).:]|[A-Da-d][ \t\n\r\f]*[-–])[ \t\n\r\f]+', ''), chr(9) || chr(10) || chr(12) || chr(13) || ' ')), lambda x: x <> '') AS a FROM i),
    d AS (SELECT *, list_filter(a, lambda x, n: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = n) AS b, trim(answer) AS t FROM c),
    e AS (SELECT *, CASE kind WHEN 'mcq' THEN CASE WHEN len(b) >= 2 THEN coalesce(list_filter(b, lambda x: lower(x) = lower(t))[1], CASE WHEN regexp_full_match(t, '[A-Da-d]') THEN b[ascii(upper(t)) - 64] END) END
        WHEN 'true_false' THEN CASE WHEN lower(regexp_replace(t, '\.+$', '')) IN (TRUES) THEN 'True' WHEN lower(regexp_replace(t, '\.+$', '')) IN (FALSES) THEN 'False' END ELSE nullif(t, '') END AS found FROM d)
    SELECT conv_id, turn, kind, trim(prompt) AS prompt, array_to_string(CASE kind WHEN 'mcq' THEN b[:6] WHEN 'true_false' THEN ['True', 'False'] ELSE [] END, '|') AS options, found AS answer FROM e WHERE trim(prompt) <> '' AND found IS NOT NULL"""


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _items_sql() -> str:
    from scholion.functions import words

    return "WITH " + _ITEMS.replace("TRUES", _words(words.TRUE)).replace("FALSES", _words(words.FALSE))


@query(_items_sql())
def normalise_items(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (n + 1).cast("int"))
    said = table(spark, sf, "conversations").withColumn("o", F.split("text", " ", -1)).withColumn("kind", pick(("mcq", "true_false", "short_answer"), F.col("turn") % 3))
    word = lambda n: F.coalesce(F.get("o", F.lit(n)), F.lit(""))
    options = F.array(*[F.concat(F.lit(p), word(n)) for n, p in enumerate(("A) ", "(b). ", "C - ", "", "d: "))])
    by = F.col("conv_id") % 4
    answer = F.when(F.col("kind") == "mcq", pick(("B", "c", F.concat(word(1), F.lit(" ")), "none"), by)).when(F.col("kind") == "true_false", pick(("Yes.", "falsch", " F ", "对"), by)).otherwise(F.when(by == 0, "  ").otherwise(F.col("text")))
    items = said.select("conv_id", "turn", "kind", F.concat(F.lit(" "), "text").alias("prompt"), options.alias("options"), answer.alias("answer"))
    return quiz.normalised(items).withColumn("options", F.array_join("options", "|"))
