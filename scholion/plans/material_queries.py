"""Queries over sections, prompts, formats, ingest and listings; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.functions import formats
from scholion.functions import text as X
from scholion.operators import ingest, search, study, tables, upkeep
from scholion.plans import registry
from scholion.plans.registry import _FUSED, SQL, query
from scholion.sources.readers import table
from scholion.sources.scratch import stored

_CLEAN = SQL["clean_whitespace"].split("SELECT doc_id, ", 1)[1].rsplit(" AS cleaned", 1)[0]
_SOFT = r"""acc <> '' AND x <> '' AND regexp_extract(acc, '[^\n]*$') <> '' AND NOT regexp_matches(x, '^(?:[-•*▪●◦]|\d+[.)]|[a-z][.)])\s') AND ((lower(x[1]) = x[1] AND upper(x[1]) <> x[1])
    OR regexp_matches(acc, '[,;(\-–/]$') OR (length(regexp_extract(acc, '[^\n]*$')) > 60 AND NOT regexp_matches(acc, '[.!?:。！？：]$')))"""


def _reflowed(column: str) -> str:
    return f"list_reduce(list_transform(string_split({column}, chr(10)), lambda y: trim(y)), lambda acc, x: CASE WHEN {_SOFT} THEN acc || ' ' || x ELSE acc || chr(10) || x END)"


_HEADING = r"CASE WHEN length(split_part(content, chr(10), 1)) BETWEEN 3 AND 90 AND NOT regexp_matches(split_part(content, chr(10), 1), '[.,;]$') THEN split_part(content, chr(10), 1) END"


@query(f"WITH c AS (SELECT doc_id, coalesce({_CLEAN}, '') AS c FROM documents), r AS (SELECT doc_id, {_reflowed('c')} AS content FROM c) SELECT doc_id, {_HEADING} AS section, content FROM r WHERE content <> ''")
def page_sections(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return ingest.page_sections(pages, "doc_id", "page", "text").drop("page")


@query(f"""WITH p AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS t FROM conversations), s AS (SELECT *, sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section_seq FROM p WHERE t <> ''),
    g AS (SELECT conv_id, section_seq, max(left(t, 300)) FILTER (WHERE role = 'system') AS section, string_agg(t, chr(10) ORDER BY turn) AS text FROM s GROUP BY ALL) SELECT conv_id, section_seq, section, {_CLEAN} AS content FROM g""")
def paragraph_sections(spark, sf):
    # A conversation as a document: its system turns are headings.
    said = table(spark, sf, "conversations").withColumn("style", F.when(F.col("role") == "system", "Heading 1").otherwise("Normal"))
    return ingest.paragraph_sections(said, "conv_id", "turn", "style", "text")


@query(f"""WITH k AS (SELECT conv_id, turn, turn // 4 AS slide, regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS t, CASE turn % 4 WHEN 0 THEN 'title' WHEN 3 THEN 'notes' ELSE 'text' END AS kind, turn % 3 AS level FROM conversations),
    l AS (SELECT conv_id, slide, turn, kind, t, CASE kind WHEN 'title' THEN 0 WHEN 'notes' THEN 2 ELSE 1 END AS r, CASE WHEN kind = 'notes' THEN 'Speaker notes: ' || t WHEN kind = 'text' AND level > 0 THEN repeat('  ', level::INT) || '- ' || t ELSE t END AS line FROM k WHERE t <> ''),
    g AS (SELECT conv_id, slide, max(t) FILTER (WHERE kind = 'title') AS section, string_agg(line, chr(10) ORDER BY r, turn) AS text FROM l GROUP BY ALL) SELECT conv_id, slide, section, {_CLEAN} AS content FROM g""")
def slide_sections(spark, sf):
    # Four turns as a slide: title, two lines at a level each, notes.
    shapes = table(spark, sf, "conversations").withColumn("slide", F.floor(F.col("turn") / 4)).withColumn("kind", F.when(F.col("turn") % 4 == 0, "title").when(F.col("turn") % 4 == 3, "notes").otherwise("text")).withColumn("level", F.col("turn") % 3)
    return ingest.slide_sections(shapes, "conv_id", "slide", "turn", "kind", "level", "text")


_N = "floor({0} * {1} + 0.5::DOUBLE) / {1}"


@query(f"""WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents), s AS (SELECT doc_id, n, n * 97.0::DOUBLE AS sec, n / 50.0::DOUBLE AS days FROM b),
    t AS (SELECT *, floor(sec / 60 + 0.5) AS mi FROM s), u AS (SELECT *, floor(mi / 60 + 0.5) AS ho FROM t), v AS (SELECT *, floor(ho / 24 + 0.5) AS da FROM u)
    SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' END AS size,
        CASE WHEN sec < 45 THEN 'just now' WHEN mi < 60 THEN mi::BIGINT || 'm ago' WHEN ho < 24 THEN ho::BIGINT || 'h ago' WHEN da < 30 THEN da::BIGINT || 'd ago' ELSE 'long ago' END AS age,
        CASE WHEN days < 1 / 24.0::DOUBLE THEN greatest(1, floor(days * 1440 + 0.5)::BIGINT) || 'm' WHEN days < 1 THEN floor(days * 24 + 0.5)::BIGINT || 'h' WHEN days < 30 THEN floor(days + 0.5)::BIGINT || 'd'
            WHEN days < 365 THEN floor(days / 30 + 0.5)::BIGINT || 'mo' ELSE printf('%.1f', floor(days / 365 * 10 + 0.5) / 10) || 'y' END AS "interval" FROM v""")
def human_formats(spark, sf):
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", formats.human_bytes(n).alias("size"), formats.human_age(n * 97.0, F.lit("long ago")).alias("age"), formats.human_interval(n / 50.0).alias("interval"))


@query(r"""WITH a AS (SELECT doc_id, left(coalesce(text, ''), 5000) || ' [1, 3] [9] ```[2]``` [4](u) [' || (doc_id % 7)::VARCHAR || '，2]' AS m FROM documents),
    t AS (SELECT doc_id, regexp_extract_all(m, '(?s)```.*?```|\[\d+(?:[ \t\n\r\f]*[,，][ \t\n\r\f]*\d+)*\]\(?|[^\[`]+|.') AS t FROM a)
    SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^\[\d') AND x LIKE '%]' AND len(list_filter(regexp_extract_all(x, '\d+'), lambda n: coalesce(TRY_CAST(n AS INT) BETWEEN 1 AND 5, false))) = len(regexp_extract_all(x, '\d+'))
        THEN array_to_string(list_transform(regexp_extract_all(x, '\d+'), lambda n: '[' || n::INT || '](#cite-' || n::INT || ')'), '') ELSE x END), '') AS linked FROM t""".replace("left(coalesce(text, ''), 5000)", "coalesce(text, '')"))
def linked_citations(spark, sf):
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [1, 3] [9] ```[2]``` [4](u) ["), (F.col("doc_id") % 7).cast("string"), F.lit("，2]"))
    return table(spark, sf, "documents").select("doc_id", formats.linked_citations(answer, F.lit(5)).alias("linked"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN turn END AS turn_read, CASE WHEN turn % 4 < 3 THEN role END AS role_read FROM conversations")
def json_objects(spark, sf):
    # Model output as it comes: bare, fenced, in prose, and broken.
    made = F.to_json(F.struct("turn", "role"))
    text = F.element_at(F.array(made, F.concat(F.lit("```json\n"), made, F.lit("\n```")), F.concat(F.lit("Here it is: "), made, F.lit(" - done.")), F.concat(F.lit("{"), made)), (F.col("turn") % 4 + 1).cast("int"))
    read = F.from_json(formats.json_object(text), "turn long, role string")
    return table(spark, sf, "conversations").select("conv_id", "turn", read.alias("o")).select("conv_id", "turn", F.col("o.turn").alias("turn_read"), F.col("o.role").alias("role_read"))


@query(f"WITH w AS (SELECT item_id, unnest({registry.tok('text')}) AS term FROM benchmark) SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL")
def tsvector_terms(spark, sf):
    # Items as an index stores them: every term with its places.
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(X.tokens(F.col("text"))).alias("p", "t"))
    entry = F.concat(F.lit("'"), F.replace("t", F.lit("'"), F.lit("''")), F.lit("':"), F.array_join(F.array_sort(F.collect_list("p")).cast("array<string>"), ","))
    lines = words.groupBy("item_id", "t").agg(entry.alias("e")).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("e")), " ").alias("e"))
    return lines.select("item_id", F.explode(formats.term_frequencies(F.col("e"))).alias("x")).select("item_id", "x.term", "x.tf")


_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations WHERE role = 'assistant'),
    b AS (SELECT conv_id, string_agg('<source id="' || i || '" file="' || role || '">' || chr(10) || {_XML.format("coalesce(text, '')")} || chr(10) || '</source>', chr(10) ORDER BY i) AS b FROM s GROUP BY conv_id),
    q AS (SELECT conv_id, arg_min(coalesce(text, ''), turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, CASE WHEN b IS NULL THEN '{ingest.NONE}' ELSE '<sources>' || chr(10) || b || chr(10) || '</sources>' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '{ingest.WEAK.replace("'", "''")}' ELSE '' END END || chr(10) || chr(10) || 'Question: ' || question AS message FROM q LEFT JOIN b USING (conv_id)""")
def question_messages(spark, sf):
    from pyspark.sql import Window

    said = table(spark, sf, "conversations")
    sources = said.filter("role = 'assistant'").withColumn("index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    sources = sources.select("conv_id", "index", ingest.source_block(F.col("index"), F.col("role"), F.lit(None).cast("string"), F.coalesce("text", F.lit(""))).alias("block"))
    asked = said.filter("role = 'user'").groupBy("conv_id").agg(F.min_by(F.coalesce("text", F.lit("")), "turn").alias("question")).withColumn("weak", F.col("conv_id") % 2 == 0)
    return ingest.question_messages(sources, asked, "conv_id")


@query(r"""WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, length(regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) AS n FROM documents), e AS (SELECT *, CASE WHEN n = 0 THEN 'no_text' WHEN n > 20000 THEN 'too_long' WHEN n < 20 THEN 'no_chunks' END AS error FROM t)
    SELECT doc_id, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status, error, chars FROM e""")
def ingest_states(spark, sf):
    return ingest.ingest(table(spark, sf, "documents"), most_chars=20_000)[0].drop("chunks")


@query(f"""WITH {_FUSED}, m AS (SELECT 'vector' AS mode, query_id, doc_id, rank FROM vec UNION ALL SELECT 'keyword', query_id, doc_id, rank FROM ranked UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused),
    h AS (SELECT mode, query_id, min(rank) AS rank FROM m JOIN benchmark ON query_id = item_id JOIN documents USING (doc_id) WHERE contains(documents.text, benchmark.text) GROUP BY ALL)
    SELECT q.query_id, max(h.rank) FILTER (WHERE mode = 'vector') AS vector_rank, max(h.rank) FILTER (WHERE mode = 'keyword') AS keyword_rank, max(h.rank) FILTER (WHERE mode = 'hybrid') AS hybrid_rank, any_value(f.doc_id) AS top_hit
    FROM queries q LEFT JOIN h USING (query_id) LEFT JOIN fused f ON f.query_id = q.query_id AND f.rank = 1 GROUP BY q.query_id""")
def report_rows(spark, sf):
    bench, docs, ranks = registry._benchmark(spark, sf), table(spark, sf, "documents"), registry._rankings(spark, sf)
    fused = stored(search.fuse(ranks), "fused")
    modes = ranks.select(F.col("source").alias("mode"), "query_id", "doc_id", "rank").unionByName(fused.select(F.lit("hybrid").alias("mode"), "query_id", "doc_id", "rank"))
    hits = modes.join(search.hit_texts(docs.select("doc_id", "text"), ranks), "doc_id").join(bench, "query_id").filter(F.contains("text", "query")).groupBy("query_id").agg(*[F.min(F.when(F.col("mode") == m, F.col("rank"))).alias(f"{m}_rank") for m in ("vector", "keyword", "hybrid")])
    return bench.select("query_id").join(hits, "query_id", "left").join(fused.filter("rank = 1").select("query_id", F.col("doc_id").alias("top_hit")), "query_id", "left")


@query("""WITH d AS (SELECT source, count(*) AS documents FROM documents GROUP BY source), l AS (SELECT source, count(*) AS labelled FROM labels JOIN documents USING (doc_id) GROUP BY source), t AS (SELECT source, count(*) AS toxic FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY source)
    SELECT d.source, documents, coalesce(labelled, 0) AS labelled, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (source) LEFT JOIN t USING (source)""")
def scope_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    labels = table(spark, sf, "labels").join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return tables.counted(docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents")), labels, "source")


@query("SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS position, c_custkey FROM customer QUALIFY position BETWEEN 10 AND 29")
def paged_listing(spark, sf):
    return tables.newest(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment", "c_acctbal", "c_custkey", 20, 10).select("c_mktsegment", "position", "c_custkey")


@query("SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey % 50 AS scope FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 50 = l_suppkey % 50)")
def ids_outside_scope(spark, sf):
    # Lines ask for orders in the scope of their supplier; orders are in that of their customer.
    wanted = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 50).alias("scope"))
    held = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("scope"))
    return tables.not_in_scope(wanted, held, ["o_orderkey", "scope"])


@query()
def normalized_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalized(F.col("text")).alias("text"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), t AS (SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, event_id FROM t, n WHERE event_type <> 'error' AND ts + INTERVAL 7 DAY > now""")
def valid_tokens(spark, sf):
    # Events as reset tokens, good for a week; those of errors are used.
    events = table(spark, sf, "events").withColumn("ts", F.date_trunc("microsecond", "ts"))
    # The clock is one row.
    timed = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    used = F.when(F.col("event_type") == "error", F.col("ts"))
    return upkeep.valid_tokens(timed, "user_id", ["ts", "event_id"], used, F.col("ts") + F.expr("INTERVAL 7 DAY"), F.col("now")).select("user_id", "event_id")


@query("SELECT event_id, sha256('login:' || user_id || ':3600:' || (floor(epoch(ts) / 3600) * 3600)::BIGINT) AS window_key FROM events")
def window_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", upkeep.window_key(F.lit("login"), F.col("user_id"), 3600, F.col("ts")).alias("window_key"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), f AS (SELECT source, first(lang ORDER BY n DESC, lang) AS m, count(*) AS d FROM c GROUP BY source)
    SELECT source, CASE WHEN d = 1 THEN m ELSE m || ' and ' || (d - 1) || ' more' END AS label FROM f""")
def deck_labels(spark, sf):
    return study.deck_label(table(spark, sf, "documents").filter("lang is not null"), "source", "lang")


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS questions, count(l_orderkey) AS attempts, max(l_quantity) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def quiz_summary(spark, sf):
    # Customers as quizzes, orders as questions, lines as attempts.
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("c_custkey", F.col("l_quantity").alias("score"))
    return study.quiz_summary(table(spark, sf, "customer"), orders, lines, "c_custkey")


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, i AS index, i IN (2, 1 + conv_id % 4) AND i <= n AS cited FROM s""")
def cited_sources(spark, sf):
    # An answer that cites the second turn and one by the conversation's number.
    said = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("_t"))
    sources = F.transform("_t", lambda t, i: F.struct((i + 1).alias("index")))
    answer = F.concat(F.lit("As said [2, "), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("] and [99]."))
    return said.select("conv_id", F.explode(study.cited_sources(sources, answer)).alias("s")).select("conv_id", F.col("s.index").cast("long").alias("index"), "s.cited")
