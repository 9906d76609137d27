"""Queries over words, chunks, gates and mined terms; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholion.functions import words as W
from scholion.functions.text import tokens as plain_tokens
from scholion.operators import chunks as C
from scholion.operators import evaluation, gates, index, search, terms
from scholion.plans import registry
from scholion.plans.registry import _STEM, query, tok
from scholion.sources.readers import table


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"WITH w AS (SELECT unnest({tok('text')}) AS w FROM documents), s AS (SELECT {_STEM} AS stem FROM w) SELECT stem, count(*) AS n FROM s GROUP BY stem")
def stem_counts(spark, sf):
    # Words are counted first, so each distinct word is stemmed once.
    found = table(spark, sf, "documents").select(F.explode(plain_tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(W.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_ \t\n\r\f-]+', '', 'g'), '[ \t\n\r\f_-]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM documents)
    SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE left(s, 60) END AS slug FROM s""")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.slug(F.col("text")).alias("slug"))


_NAME = "regexp_extract(regexp_replace(coalesce(url, ''), '/+$', ''), '[^/]*$')"
_FILES = f"""n AS (SELECT page_id, html, CASE WHEN trim({_NAME}) = '' THEN 'upload' ELSE left(trim({_NAME}), 255) END || CASE page_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.ppt' WHEN 3 THEN '.markdown' ELSE '.exe' END AS name FROM pages),
    k AS (SELECT *, lower(regexp_extract(name, '[^.]\\.([^.]+)$', 1)) AS kind FROM n),
    f AS (SELECT page_id, name, CASE kind WHEN 'markdown' THEN 'md' ELSE kind END AS file_type, sha256(coalesce(html, '')) AS digest,
        CASE WHEN kind IN ({_list(W.LEGACY)}) THEN 'legacy_type' WHEN kind NOT IN ({_list(W.TYPES)}) THEN 'unsupported_type' WHEN strlen(html) > 8000 THEN 'too_large' WHEN coalesce(strlen(html), 0) = 0 THEN 'empty_file'
        WHEN kind = 'pdf' AND NOT regexp_matches(html, '^[ \\t\\n\\r\\f]*%PDF') THEN 'not_a_pdf' END AS error_code FROM k)"""


def _files(spark, sf):
    # Pages as uploads: their own names with the suffixes that the gates tell apart.
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".PDF", ".ppt", ".markdown", ".exe"))), (F.col("page_id") % 5 + 1).cast("int"))
    named = table(spark, sf, "pages").select("page_id", F.concat(W.safe_filename(F.col("url")), suffix).alias("name"), F.col("html").cast("binary").alias("_c"))
    return named.select("page_id", "name", W.file_type(F.col("name")).alias("file_type"), F.sha2(F.coalesce("_c", F.lit(b"")), 256).alias("digest"), gates.file_error(F.col("name"), F.col("_c"), 8000).alias("error_code"))


@query(f"WITH {_FILES} SELECT * FROM f")
def file_gates(spark, sf):
    return _files(spark, sf)


@query(f"WITH {_FILES}, b AS (SELECT page_id // 15 AS batch, count(*) AS files, count(*) FILTER (WHERE error_code IS NULL) AS accepted FROM f GROUP BY 1) SELECT *, CASE WHEN files > 20 THEN 'too_many_files' WHEN accepted = 0 THEN 'none_accepted' END AS error FROM b")
def batch_gates(spark, sf):
    return gates.batch_errors(_files(spark, sf).withColumn("batch", F.floor(F.col("page_id") / 15)), "batch", "error_code", 20)



@query(f"""WITH s AS (SELECT user_id, max(ts) AS seen, min(ts) + INTERVAL 60 DAY AS expires, max(ts) FILTER (WHERE event_type = 'error') AS revoked FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, CASE WHEN revoked = seen THEN 'revoked' WHEN expires <= now THEN 'expired' WHEN epoch(seen)::BIGINT + 86400 <= epoch(now)::BIGINT THEN 'idle' WHEN user_id % 7 = 0 THEN 'disabled' ELSE 'active' END AS state FROM s, n""")
def session_states(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.date_trunc("microsecond", "ts"))
    held = events.groupBy("user_id").agg(F.max("ts").alias("seen"), (F.min("ts") + F.expr("INTERVAL 60 DAY")).alias("expires"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("_r"))
    # The clock is one row.
    timed = held.join(F.broadcast(events.agg(F.max("ts").alias("now")))).withColumn("revoked", F.when(F.col("_r") == F.col("seen"), F.col("_r")))
    return timed.select("user_id", gates.session_state(F.col("revoked"), F.col("expires"), F.col("seen"), F.col("user_id") % 7 != 0, F.col("now"), 86_400).alias("state"))


@query()
def chunks(spark, sf):
    return C.chunk(table(spark, sf, "documents"))


_LINES = r"""m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])[ \t\n\r\f]+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)) AS p FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS s FROM m),
    b AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(s, lambda x: string_split(x, chr(10)))), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[ \t\n\r\f]*([-•*▪●◦]|\d+[.)])[ \t\n\r\f]+', ''), '(?i)^speaker notes:[ \t\n\r\f]*', ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS b FROM s),
    l AS (SELECT doc_id, unnest(range(len(b))) AS pos, unnest(b) AS line FROM b)"""


@query(rf"""WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) BETWEEN 40 AND 280 AND len(regexp_extract_all(line, '[^ \t\n\r\f]+')) >= 6 AND length(regexp_replace(line, '[^0-9]', '', 'g')) < length(line) * 0.2::DOUBLE) AS good FROM l GROUP BY doc_id""")
def good_sentences(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(terms.candidates(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(terms.good_sentence(F.col("line"))).alias("good"))


_DEFINITIONS = rf"""WITH {_LINES}, d AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '{terms.DEFINED}') THEN regexp_extract(line, '{terms.DEFINED}', 1) WHEN regexp_matches(line, '{terms.LABELLED}') THEN regexp_extract(line, '{terms.LABELLED}', 1) END AS t,
        CASE WHEN regexp_matches(line, '{terms.DEFINED}') THEN regexp_extract(line, '{terms.DEFINED}', 2) ELSE regexp_extract(line, '{terms.LABELLED}', 2) END AS d FROM l),
    e AS (SELECT doc_id, pos, regexp_replace(t, '^[ -]+|[ -]+$', '', 'g') AS term, trim(d) AS definition FROM d WHERE t IS NOT NULL)
    SELECT doc_id, term, upper(substr(definition, 1, 1)) || substr(definition, 2) AS definition FROM e
    WHERE len(regexp_extract_all(term, '[^ \t\n\r\f]+')) BETWEEN 1 AND 6 AND lower(split_part(term, ' ', 1)) NOT IN ({_list(terms.BAD_START + terms.STRUCTURAL)}) AND NOT regexp_matches(term, '[0-9]')
        AND lower(regexp_extract(definition, '^[^ \t]+')) NOT LIKE '%ed' AND lower(regexp_extract(definition, '^[^ \t]+')) NOT IN ({_list(terms.HEDGES)}) AND len(regexp_extract_all(definition, '[^ \t\n\r\f]+')) >= 4
    QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY pos) = 1"""


@query(_DEFINITIONS)
def definitions(spark, sf):
    return terms.definitions(table(spark, sf, "documents"))


@query(r"""WITH w AS (SELECT source, doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z\-]{3,}'), lambda x: lower(x))) AS term FROM documents),
    t AS (SELECT source, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE length(term) >= 5 AND term NOT IN (SELECT unnest([STOP])) GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    s AS (SELECT source, term, round(tf * ln(1 + n / df), 6) AS score FROM t JOIN n USING (source)) SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank, term, score FROM s QUALIFY rank <= 40""".replace("STOP", ", ".join("'" + w.replace("'", "''") + "'" for w in terms.STOP_WORDS)))
def key_terms(spark, sf):
    return terms.key_terms(table(spark, sf, "documents"), "source", 40)


@query(f"""WITH d AS ({_DEFINITIONS}), dt AS (SELECT source, doc_id, term FROM d JOIN documents USING (doc_id)),
    w AS (SELECT source, doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z\\-]{{3,}}'), lambda x: lower(x))) AS term FROM documents),
    t AS (SELECT source, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE length(term) >= 5 AND term NOT IN ({registry._STOP}) GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    every AS (SELECT source, 0 AS kind, doc_id::DOUBLE AS at_, term FROM dt UNION ALL SELECT source, 1, -round(tf * ln(1 + n / df), 6), term FROM t JOIN n USING (source)),
    words AS (SELECT *, list_filter(string_split(lower(term), ' '), lambda x: x <> '') AS ws FROM every),
    stemmed AS (SELECT source, kind, at_, term, array_to_string(list_transform(ws, lambda w: {_STEM}), ' ') AS stem FROM words),
    once AS (SELECT * FROM stemmed QUALIFY row_number() OVER (PARTITION BY source, stem ORDER BY kind, at_, term) = 1)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY kind, at_, term) AS rank, term, kind = 0 AS defined FROM once QUALIFY rank <= 40""")
def concept_terms(spark, sf):
    return terms.concept_terms(table(spark, sf, "documents"), "source", 40)


_ANSWERS = rf"""WITH {registry._bm25_sql('len', 'avg_len', 5)},
    m AS (SELECT query_id, rank, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])[ \t\n\r\f]+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)) AS p FROM ranked JOIN documents USING (doc_id)),
    b AS (SELECT query_id, rank, list_filter(list_transform(flatten(list_transform(p, lambda x: string_split(regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), chr(10)))), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[ \t\n\r\f]*([-•*▪●◦]|\d+[.)])[ \t\n\r\f]+', ''), '(?i)^speaker notes:[ \t\n\r\f]*', ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS b FROM m),
    l AS (SELECT query_id, rank, unnest(range(len(b))) AS pos, unnest(b) AS line FROM b),
    c AS MATERIALIZED (SELECT * FROM l WHERE length(line) >= 25 AND len(regexp_extract_all(line, '[^ \t\n\r\f]+')) >= 6 AND lower(regexp_extract(line, '^[^ \t\n\r\f]+')) NOT IN ({_list(terms.BAD_START)})),
    lt AS MATERIALIZED (SELECT DISTINCT query_id, rank, pos, line, {_STEM} AS term FROM (SELECT *, unnest({tok('line')}) AS w FROM c)),
    qt AS (SELECT DISTINCT query_id, {_STEM} AS term FROM (SELECT query_id, unnest({tok('query')}) AS w FROM queries)),
    z AS (SELECT query_id, rank, pos, count(*) AS size FROM lt GROUP BY ALL), nn AS (SELECT query_id, count(*) AS n FROM c GROUP BY query_id),
    sh AS (SELECT * FROM lt SEMI JOIN qt USING (query_id, term)), dd AS (SELECT query_id, term, count(*) AS df FROM sh GROUP BY ALL),
    sc AS (SELECT query_id, rank, pos, line, round(sum(ln(1 + n / (1 + df))) / sqrt(any_value(size) + 1) + 0.4::DOUBLE / rank + CASE WHEN regexp_matches(line, '{terms.DEFINED}') THEN 0.3::DOUBLE ELSE 0 END, 6) AS score
        FROM sh JOIN dd USING (query_id, term) JOIN nn USING (query_id) JOIN z USING (query_id, rank, pos) GROUP BY query_id, rank, pos, line),
    o AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, lower(substr(line, 1, 80)) ORDER BY score DESC, rank, pos) = 1)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS position, rank AS source_rank, line, score FROM o QUALIFY position <= 4"""


@query(_ANSWERS)
def extractive_answers(spark, sf):
    docs, asked = table(spark, sf, "documents"), registry._benchmark(spark, sf)
    return terms.answers(search.bm25(docs, asked), docs, asked)


_LINE = r"regexp_replace(regexp_replace(line, '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g')"
_CUT_LINE = f"CASE WHEN length({_LINE}) <= 320 THEN {_LINE} ELSE regexp_replace(regexp_replace(substr({_LINE}, 1, 320), ' [^ ]*$', ''), '[,.;: ]+$', '') || '…' END"


@query(f"""WITH x AS ({_ANSWERS}), b AS (SELECT query_id, string_agg('- ' || {_CUT_LINE} || ' [' || source_rank || ']', chr(10) ORDER BY position) AS b FROM x GROUP BY query_id)
    SELECT item_id AS query_id, coalesce('{terms.ANSWER_HEAD}' || chr(10) || chr(10) || b, '{terms.NOT_COVERED.replace("'", "''")}') AS answer FROM benchmark LEFT JOIN b ON query_id = item_id""")
def answer_texts(spark, sf):
    docs, asked = table(spark, sf, "documents"), registry._benchmark(spark, sf)
    return terms.answer_texts(terms.answers(search.bm25(docs, asked), docs, asked), asked)


@query("""SELECT source, count(*) FILTER (WHERE length(text) >= 20) AS ready, count(*) FILTER (WHERE length(text) >= 20 AND lang IS DISTINCT FROM 'en') AS stale,
    CASE WHEN ready = 0 THEN 'no_materials' WHEN stale > 0 THEN 'stale_index' END AS error FROM documents GROUP BY source""")
def scope_readiness(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", (F.length("text") >= 20).cast("int").alias("_c"))
    return index.scope_readiness(docs, "source", F.col("lang"), F.lit("en"), F.col("_c"))


@query()
def study_sample(spark, sf):
    docs = table(spark, sf, "documents")
    pieces = C.chunk(docs).join(docs.select("doc_id", F.col("source").alias("scope")), "doc_id")
    return index.study_sample(pieces, "scope", 12)


_RANKED_TEXTS = "SELECT query_id, rank, source AS file, doc_id % 5 AS page, lang AS section FROM ranked JOIN documents USING (doc_id)"


@query(f"""WITH {registry._bm25_sql('len', 'avg_len', 10)}, hits AS ({_RANKED_TEXTS}),
    places AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents)),
    targets AS (SELECT item_id AS query_id, source AS file, CASE WHEN item_id % 2 = 0 THEN item_id % 5 END AS page, CASE WHEN item_id % 3 = 0 THEN 'en' END AS section FROM benchmark JOIN places ON i IN (item_id % m, (item_id + 1) % m))
    SELECT h.query_id, rank, file, page, section, EXISTS (SELECT 1 FROM targets t WHERE t.query_id = h.query_id AND t.file = h.file AND (t.page = h.page OR t.section = h.section)) AS relevant FROM hits h""")
def relevance_labels(spark, sf):
    # A question's targets are two sources, with a page (even items), a section (every third), or neither, which nothing meets.
    docs, asked = table(spark, sf, "documents"), registry._benchmark(spark, sf)
    hits = search.bm25(docs, asked, 10).join(docs.select("doc_id", F.col("source").alias("file"), (F.col("doc_id") % 5).alias("page"), F.col("lang").alias("section")), "doc_id").select("query_id", "rank", "file", "page", "section")
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_r"))
    sources = sources.withColumn("_i", F.row_number().over(Window.orderBy("source")) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    item = asked.select("query_id").join(F.broadcast(sources), (F.col("_i") == F.col("query_id") % F.col("_m")) | (F.col("_i") == (F.col("query_id") + 1) % F.col("_m")))
    targets = item.select("query_id", F.col("source").alias("file"), F.when(F.col("query_id") % 2 == 0, F.col("query_id") % 5).alias("page"), F.when(F.col("query_id") % 3 == 0, "en").alias("section"))
    return evaluation.relevance(hits, targets)


@query(f"""WITH RECURSIVE c AS (SELECT conv_id % 5 AS scope, conv_id AS doc_id, turn AS chunk_index, length(text) AS n FROM conversations),
    u AS (SELECT * FROM (SELECT *, bool_or(n >= 60) OVER (PARTITION BY scope, doc_id) AS any_long FROM c) WHERE n >= 60 OR NOT any_long),
    k AS (SELECT *, row_number() OVER (PARTITION BY scope, doc_id ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY scope, doc_id) AS m FROM u),
    q AS (SELECT scope, ceil(30 / count(DISTINCT doc_id))::BIGINT AS q FROM c GROUP BY scope),
    d AS (SELECT DISTINCT scope, doc_id, m, least(q, m) AS q, ('0x' || substr(md5('7:' || scope || ':' || doc_id), 1, 5))::BIGINT AS h FROM k JOIN q USING (scope)),
    p AS (SELECT scope, doc_id, t, ((h + t * {index.PARTS}) * m) // (q * {index.PARTS}) AS i FROM (SELECT *, unnest(range(q)) AS t FROM d)),
    o AS (SELECT p.scope, p.doc_id, chunk_index, n, row_number() OVER (PARTITION BY p.scope ORDER BY t, p.doc_id) AS o FROM p JOIN k ON k.scope = p.scope AND k.doc_id = p.doc_id AND k.i = p.i),
    f AS (SELECT scope, 0::BIGINT AS o, 0::BIGINT AS total, 0::BIGINT AS chosen, false AS taken FROM (SELECT DISTINCT scope FROM o)
        UNION ALL SELECT scope, o, total + CASE WHEN fits THEN n ELSE 0 END, chosen + fits::INT, fits FROM (SELECT f.scope, o.o, total, chosen, n, chosen < 30 AND (chosen = 0 OR total + n <= 2000) AS fits FROM f JOIN o ON o.scope = f.scope AND o.o = f.o + 1))
    SELECT scope, chosen AS position, doc_id, chunk_index FROM f JOIN o USING (scope, o) WHERE taken""")
def study_sample_budget(spark, sf):
    # Turns as chunks of their conversation.
    turns = table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("scope"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.length("text").cast("long").alias("char_count"))
    return index.study_sample(turns, "scope", 30, 60, 2000, 7)
