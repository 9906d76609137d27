"""The library's queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions import text as X
from scholion.operators import keyword_index, search, study, tables
from scholion.sources.readers import deck_line, table
from scholion.sources.scratch import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
_PATTERN = X.TOKEN.replace("'", "''")
_TOK = f"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '{_PATTERN}'), lambda t: t NOT IN ({_STOP}) AND (length(t) > 1 OR t >= '぀'))"


def tok(column: str) -> str:
    return _TOK.format(column)


_CUT = "substr({0}, 1, length({0}) - {1})"
_BASE = "regexp_replace(w, '(ing|ed)$', '')"
_STEM = f"""CASE WHEN NOT regexp_full_match(w, '[a-z]{{4,}}') THEN w WHEN regexp_matches(w, '^.{{2,}}ies$') THEN {_CUT.format('w', 3)} || 'y'
    WHEN regexp_matches(w, '(sses|ches|shes|xes)$') THEN {_CUT.format('w', 2)} WHEN regexp_matches(w, '[sui]s$') THEN w WHEN w LIKE '%s' THEN {_CUT.format('w', 1)}
    WHEN NOT regexp_matches(w, '^.{{3,}}(ing|ed)$') THEN w WHEN regexp_matches({_BASE}, '(at|iz|bl|uc|v)$') THEN {_BASE} || 'e'
    WHEN right({_BASE}, 1) = substr({_BASE}, -2, 1) AND right({_BASE}, 1) NOT IN ('l', 's', 'z') THEN {_CUT.format(_BASE, 1)} ELSE {_BASE} END"""

def stemmed(column: str) -> str:
    return f"list_transform({tok(column)}, lambda w: {_STEM})"


#: Stems ``s`` and the pairs of neighbouring CJK characters among them.
_KEYWORDS = "list_concat(s, list_filter(list_transform(range(1, len(s)), lambda i: CASE WHEN s[i] >= '぀' AND s[i + 1] >= '぀' THEN s[i] || s[i + 1] END), lambda p: p IS NOT NULL))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms, array_to_string(t, ' ') AS tokens FROM t")
def tokens(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents), b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS bigram FROM t) SELECT bigram, count(*)::BIGINT AS n FROM b GROUP BY bigram")
def token_bigrams(spark, sf):
    docs = table(spark, sf, "documents")
    return search.occurrences(docs.select(F.explode(X.bigrams(X.tokens(F.col("text")))).alias("bigram")), "bigram", docs.count())


@query(r"""
    WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])[ \t\n\r\f]+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)) AS p FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x <> '') AS s FROM m),
    e AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM s) SELECT doc_id, pos::BIGINT AS pos, sentence FROM e""")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS cleaned FROM documents""")
def clean_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_whitespace(F.col("text")).alias("cleaned"))


@query(r"""
    WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) <= 320 THEN flat ELSE regexp_replace(regexp_replace(substr(flat, 1, 320), ' [^ ]*$', ''), '[,.;: ]+$', '') || '…' END AS snippet FROM f""")
def truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 320).alias("snippet"))


@query(r"""
    WITH l AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS line FROM documents)
    SELECT doc_id, CASE WHEN length(line) BETWEEN 3 AND 90 AND NOT regexp_matches(line, '[.,;]$') THEN line END AS heading FROM l""")
def first_line_heading(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_line_heading(F.col("text")).alias("heading"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?'"


@query(f"""
    WITH u AS (SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) AS s, lower(regexp_extract(url, {_URL}, 2)) AS h, regexp_extract(url, {_URL}, 3) AS p FROM pages)
    SELECT page_id, CASE WHEN s <> '' THEN s || '://' || h || CASE WHEN p = '' OR (s = 'http' AND p = '80') OR (s = 'https' AND p = '443') THEN '' ELSE ':' || p END END AS origin FROM u""")
def url_origins(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.origin(F.col("url")).alias("origin"))


_QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def _benchmark(spark, sf):
    """Whole items as queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25_sql(length: str, mean: str, k: int) -> str:
    return f"""{_QUERIES},
    t AS MATERIALIZED (SELECT *, len(t) AS len, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {_KEYWORDS} AS t FROM (SELECT doc_id, {stemmed('text')} AS s FROM documents))),
    s AS (SELECT count(*) AS n, avg(len) AS avg_len, avg(n_terms) AS avg_terms FROM t),
    p AS (SELECT doc_id, term, len, n_terms, count(*) AS tf FROM (SELECT doc_id, len, n_terms, unnest(t) AS term FROM t) GROUP BY ALL),
    q AS (SELECT DISTINCT query_id, unnest({_KEYWORDS}) AS term FROM (SELECT query_id, {stemmed('query')} AS s FROM queries)),
    d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
    r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * {length} / {mean}))), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), s GROUP BY ALL),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {k})"""


@query(f"WITH {_bm25_sql('len', 'avg_len', 5)} SELECT * FROM ranked")
def bm25_topk(spark, sf):
    return search.bm25(table(spark, sf, "documents"), _benchmark(spark, sf))


@query(f"WITH {_bm25_sql('n_terms', 'avg_terms', 5)} SELECT * FROM ranked")
def bm25_distinct_len_topk(spark, sf):
    return search.bm25(table(spark, sf, "documents"), _benchmark(spark, sf), distinct_len=True)


_POOL_SQL = _bm25_sql("n_terms", "avg_terms", 5).replace("round(sum(ln(", "sum(tf) AS held, round(sum(ln(")
_POOL_SQL = _POOL_SQL.replace("FROM r WHERE score > 0", "FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY held DESC, doc_id) <= 200) WHERE score > 0")


@query(f"WITH {_POOL_SQL} SELECT * FROM ranked")
def bm25_pool_topk(spark, sf):
    # The pool of a search for 5: the greater of 5 * 5 and 200.
    return search.bm25(table(spark, sf, "documents"), _benchmark(spark, sf), distinct_len=True, pool=200)


def _scoped_sql(asked: str, looked_at: str) -> str:
    """BM25 where each query looks at documents of its own: ``looked_at`` (query_id, doc_id)."""
    return f"""WITH t AS MATERIALIZED (SELECT *, len(t) AS len FROM (SELECT doc_id, source, {_KEYWORDS} AS t FROM (SELECT doc_id, source, {stemmed('text')} AS s FROM documents))),
    asked AS (SELECT item_id AS query_id, text AS query, scope FROM benchmark JOIN ({asked}) USING (item_id)),
    looked AS ({looked_at}), u AS (SELECT l.query_id, t.* FROM looked l JOIN t USING (doc_id)),
    s AS (SELECT query_id, count(*) AS n, avg(len) AS mean FROM u GROUP BY query_id),
    q AS (SELECT DISTINCT query_id, unnest({_KEYWORDS}) AS term FROM (SELECT query_id, {stemmed('query')} AS s FROM asked)),
    p AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    h AS (SELECT q.query_id, p.* FROM q JOIN p USING (term) JOIN looked l ON l.query_id = q.query_id AND l.doc_id = p.doc_id), d AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM h JOIN d USING (query_id, term) JOIN s USING (query_id) GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 5"""


def _scoped(spark, sf):
    """An index of all documents, and queries that each ask in one source, taken in turn."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("scope"), "text")
    path = scratch_path(spark, "index")
    keyword_index.index_documents(spark, path, docs)
    sources = docs.groupBy("scope").agg(F.min("doc_id").alias("_d"))
    sources = sources.withColumn("_i", F.row_number().over(Window.orderBy("scope")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    items = table(spark, sf, "benchmark")
    asked = items.join(F.broadcast(sources), F.pmod("item_id", "_n") == F.col("_i"))
    return path, docs, asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "scope")


_ASKED = "SELECT item_id, s.source AS scope FROM benchmark JOIN (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) s ON item_id % s.n = s.i"


@query(_scoped_sql(_ASKED, "SELECT query_id, doc_id FROM asked JOIN documents ON source IS NOT DISTINCT FROM scope"))
def scoped_bm25_topk(spark, sf):
    path, _, asked = _scoped(spark, sf)
    return keyword_index.search_index(spark, path, asked)


@query(_scoped_sql(_ASKED, "SELECT query_id, doc_id FROM asked JOIN documents ON source IS NOT DISTINCT FROM scope WHERE query_id % 2 = 0 OR (doc_id + query_id) % 3 = 0"))
def scoped_bm25_allowed(spark, sf):
    # Every other query names the documents it may look at, some of them of other sources.
    path, docs, asked = _scoped(spark, sf)
    allowed = asked.filter("query_id % 2 = 1").select("query_id").join(docs.select("doc_id"), (F.col("doc_id") + F.col("query_id")) % 3 == 0)
    return keyword_index.search_index(spark, path, asked, allowed=allowed)


@query(f"WITH t AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term")
def term_stats(spark, sf):
    return search.term_stats(search.postings(table(spark, sf, "documents")))


def _embed_sql(source: str) -> str:
    return f"""SELECT id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
        SELECT id, ('0x' || substr(md5(f), 1, 8))::BIGINT % 384 AS dim, sum(CASE WHEN ('0x' || substr(md5(f), 9, 1))::INT < 8 THEN 1.0 ELSE -1.0 END * (1 + ln(tf))) AS w
        FROM (SELECT id, f, count(*) AS tf FROM (SELECT id, unnest(list_concat({_KEYWORDS}, list_transform(range(1, len(s)), lambda i: s[i] || '_' || s[i + 1]))) AS f FROM ({source})) GROUP BY ALL) GROUP BY ALL) QUALIFY sum(w * w) OVER (PARTITION BY id) > 0"""


_DOC_ROWS = _embed_sql(f"SELECT doc_id AS id, {stemmed('text')} AS s FROM documents")
_QUERY_ROWS = _embed_sql(f"SELECT query_id AS id, {stemmed('query')} AS s FROM queries")


@query(f"SELECT id AS doc_id, dim, round(weight, 6) AS weight FROM ({_DOC_ROWS})")
def hash_embed(spark, sf):
    return search.hash_embed(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "dim", F.round("weight", 6).alias("weight"))


def _sparse_sql(k: int) -> str:
    return f"""de AS MATERIALIZED ({_DOC_ROWS}), qe AS MATERIALIZED ({_QUERY_ROWS}),
    sc AS (SELECT qe.id AS query_id, de.id AS doc_id, round(sum(de.weight * qe.weight), 6) AS score FROM de JOIN qe USING (dim) GROUP BY ALL),
    vec AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= {k})"""


def _vectors(spark, sf, k):
    return search.text_cosine(table(spark, sf, "documents"), search.embed(_benchmark(spark, sf), id_col="query_id", text="query"), k)


@query(f"WITH {_QUERIES}, {_sparse_sql(5)} SELECT * FROM vec")
def sparse_cosine_topk(spark, sf):
    return _vectors(spark, sf, 5)


@query("""WITH v AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.id AS query_id, c.id AS doc_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 5""")
def dense_cosine_topk(spark, sf):
    # Every vector is a query.
    vectors = table(spark, sf, "embeddings")
    return search.dense_cosine(vectors, vectors)


@query()
def lsh_topk(spark, sf):
    # Approximate: its recall against dense_cosine is measured in tests and in the README.
    vectors = table(spark, sf, "embeddings")
    return search.lsh_cosine(vectors, vectors.filter("vec_id % 100 = 0"))


def _rankings(spark, sf, k=30):
    """Both rankings, computed once for what is derived from them."""
    ranked = _vectors(spark, sf, k).withColumn("source", F.lit("vector")).unionByName(search.bm25(table(spark, sf, "documents"), _benchmark(spark, sf), k).withColumn("source", F.lit("keyword")))
    return stored(ranked, "rankings")


_FUSED = f"""{_bm25_sql('len', 'avg_len', 30)}, {_sparse_sql(30)},
    both_ranks AS (SELECT query_id, 'vector' AS source, doc_id, rank FROM vec UNION ALL SELECT query_id, 'keyword', doc_id, rank FROM ranked),
    fs AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (WHERE source = 'vector') AS v, min(rank) FILTER (WHERE source = 'keyword') AS kw FROM both_ranks GROUP BY ALL),
    fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v NULLS LAST, kw NULLS LAST, doc_id) AS rank, doc_id, score FROM fs QUALIFY rank <= 5)"""


@query(f"WITH {_FUSED} SELECT * FROM fused")
def rrf_hybrid(spark, sf):
    return search.fuse(_rankings(spark, sf))


_FLAT = r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g')"
_SNIPPET = f"CASE WHEN length({_FLAT}) <= 320 THEN {_FLAT} ELSE regexp_replace(regexp_replace(substr({_FLAT}, 1, 320), ' [^ ]*$', ''), '[,.;: ]+$', '') || '…' END"


@query(f"""WITH {_FUSED} SELECT fused.query_id, fused.rank AS index, fused.doc_id, source, lang, {_SNIPPET} AS snippet, floor(fused.score * 10000 + 0.5) / 10000 AS score, floor(vec.score * 10000 + 0.5) / 10000 AS vector_score, floor(ranked.score * 10000 + 0.5) / 10000 AS keyword_score
    FROM fused JOIN documents USING (doc_id) LEFT JOIN vec ON vec.query_id = fused.query_id AND vec.doc_id = fused.doc_id LEFT JOIN ranked ON ranked.query_id = fused.query_id AND ranked.doc_id = fused.doc_id""")
def search_output_rows(spark, sf):
    ranks = _rankings(spark, sf)
    return search.result_rows(search.fuse(ranks), table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), ranks)


@query(f"""WITH {_QUERIES}, {_sparse_sql(5)}, b AS (SELECT query_id, max(score) AS best FROM vec GROUP BY query_id), held AS (SELECT DISTINCT item_id AS query_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
    SELECT held.query_id IS NOT NULL AS answerable, count(*) AS n, round(avg((coalesce(best, 0.0) < 0.25)::INT), 6) AS flagged FROM queries q LEFT JOIN b USING (query_id) LEFT JOIN held ON held.query_id = q.query_id GROUP BY 1""")
def abstention(spark, sf):
    # A question can be answered if its passage stands whole in some text.
    best = stored(_vectors(spark, sf, 5), "best")
    docs, bench = table(spark, sf, "documents"), _benchmark(spark, sf)
    near = search.containing(docs, bench).select("query_id").distinct()
    answerable = bench.select("query_id").join(near.withColumn("_a", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("_a", F.lit(False)).alias("answerable"))
    return search.abstention(best.groupBy("query_id").agg(F.max("score").alias("best_score")), answerable, 0.25)


@query(f"""WITH {_QUERIES}, {_sparse_sql(5)}
    SELECT q.query_id, round(coalesce(max(score), 0.0), 6) AS best_score, coalesce(max(score), 0.0) < 0.25 AS low_confidence FROM queries q LEFT JOIN vec USING (query_id) GROUP BY q.query_id""")
def query_confidence(spark, sf):
    best = _vectors(spark, sf, 5).groupBy("query_id").agg(F.max("score").alias("_s"))
    return _benchmark(spark, sf).join(best, "query_id", "left").select("query_id", F.round(F.coalesce("_s", F.lit(0.0)), 6).alias("best_score"), (F.coalesce("_s", F.lit(0.0)) < 0.25).alias("low_confidence"))


@query(f"""WITH {_FUSED},
    modes AS (SELECT 'vector' AS mode, query_id, doc_id, rank FROM vec UNION ALL SELECT 'keyword', query_id, doc_id, rank FROM ranked UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused),
    hits AS (SELECT mode, query_id, min(rank) AS rank FROM modes JOIN benchmark ON query_id = item_id JOIN documents USING (doc_id) WHERE contains(documents.text, benchmark.text) GROUP BY ALL),
    every AS (SELECT mode, query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, rank FROM (SELECT * FROM (SELECT unnest(['vector', 'keyword', 'hybrid']) AS mode) CROSS JOIN queries) LEFT JOIN hits USING (mode, query_id))
    SELECT mode, coalesce(category, 'all') AS category, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3,
        round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM every GROUP BY GROUPING SETS ((mode), (mode, category))""")
def eval_metrics(spark, sf):
    bench, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    ranks = _rankings(spark, sf)
    modes = ranks.select(F.col("source").alias("mode"), "query_id", "doc_id", "rank").unionByName(search.fuse(ranks).select(F.lit("hybrid").alias("mode"), "query_id", "doc_id", "rank"))
    # Documents of the fused ranking are among those of the others.
    hits = modes.join(search.hit_texts(docs.select("doc_id", F.col("text").alias("_d")), ranks), "doc_id").join(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("_q")), "query_id").filter(F.contains("_d", "_q"))
    first = hits.groupBy("mode", "query_id").agg(F.min("rank").alias("rank"))
    every = bench.select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, ("vector", "keyword", "hybrid")))).alias("mode")).join(first, ["mode", "query_id"], "left")
    return search.metrics(every.withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")))


@query("""SELECT source, sha256(coalesce(text, '')) AS sha256, doc_id, first_value(doc_id) OVER w AS first_id, row_number() OVER w > 1 AS duplicate FROM documents WINDOW w AS (PARTITION BY source, sha256(coalesce(text, '')) ORDER BY doc_id)""")
def dedup_in_batch(spark, sf):
    return tables.dedup_in_batch(table(spark, sf, "documents"), "source", "doc_id", "text")


@query("""WITH l AS (SELECT d.doc_id, source, text, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels USING (doc_id)), s AS (SELECT source, coalesce(text, '') AS t, min(doc_id) AS existing FROM l WHERE labelled GROUP BY ALL)
    SELECT doc_id, l.source, existing FROM l LEFT JOIN s ON l.source IS NOT DISTINCT FROM s.source AND coalesce(l.text, '') = s.t WHERE NOT labelled""")
def dedup_against_stored(spark, sf):
    # Documents with a label are stored already, the others are new.
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "quality")
    return tables.dedup_against(docs.filter("quality is null").drop("quality"), docs.filter("quality is not null"), ["source", "sha256"], "doc_id").select("doc_id", "source", "existing")


@query("SELECT source, count(*) AS documents, count(quality) AS labelled, (count(*) FILTER (WHERE quality = 1)) AS ready, coalesce(sum(length(text)), 0)::BIGINT AS total_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def scope_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("_c")).join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("ready"), F.coalesce(F.sum("_c"), F.lit(0)).alias("total_chars"))


@query(f"SELECT count(*) AS scopes, sum(documents)::BIGINT AS documents, sum(labelled)::BIGINT AS labelled, sum(ready)::BIGINT AS ready, sum(total_chars)::BIGINT AS total_chars FROM ({SQL['scope_stats']})")
def dashboard_totals(spark, sf):
    return tables.totals(scope_stats(spark, sf), "scopes")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def user_counts(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("t"))
    return tables.counted(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey").select("c_custkey", F.col("n").alias("n_orders"), F.round(F.col("t").cast("double"), 2).alias("total"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_message_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))


@query("SELECT * EXCLUDE (seen) FROM (SELECT conv_id, turn, role, substr(text, 1, 2000) AS content, max((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)) WHERE seen = 1")
def history_window(spark, sf):
    return tables.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n FROM conversations GROUP BY conv_id")
def transcripts(spark, sf):
    said = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("_l"))
    return said.select("conv_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("transcript"), F.size("_l").cast("long").alias("n"))


@query(r"""WITH e AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS e FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, unnest(range(len(e)))::BIGINT AS seq, unnest(e) AS token FROM e""")
def token_events(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    return said.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+[ \t\n\r\f]*"), F.lit(0))).alias("seq", "token")).withColumn("seq", F.col("seq").cast("long"))


@query("""WITH w AS (SELECT event_id, user_id, ts, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS window_start, floor(epoch(ts))::BIGINT AS t FROM events)
    SELECT event_id, user_id, window_start, row_number() OVER p AS n, row_number() OVER p > 3 AS refused, window_start + 86400 - t AS retry_after FROM w WINDOW p AS (PARTITION BY user_id, window_start ORDER BY ts, event_id)""")
def rate_windows(spark, sf):
    return tables.rate_windows(table(spark, sf, "events"), "user_id", "ts", 86_400, 3)


@query("""WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM events)
    SELECT event_id, user_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, e ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS failures FROM e""")
def failed_since_success(spark, sf):
    return tables.failures_since_success(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")


_GRADE = f"""g AS (SELECT conv_id, turn, text AS given, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations),
    gt AS (SELECT conv_id, turn, given, {stemmed('given')} AS a, list_distinct({stemmed('reference')}) AS b FROM g WHERE reference IS NOT NULL),
    gs AS (SELECT conv_id, turn, given, a, b, CASE WHEN trim(given) = '' THEN 0.0 WHEN len(b) = 0 THEN 1.0 WHEN len(list_intersect(a, b)) / len(b) >= 0.5 THEN 1.0 WHEN len(list_intersect(a, b)) / len(b) >= 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM gt)"""


def _grades(spark, sf):
    from pyspark.sql import Window

    said = table(spark, sf, "conversations").withColumn("reference", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return said.filter("reference is not null").select("conv_id", "turn", study.grade_short_answer(F.col("text"), F.col("reference")).alias("score"))


@query(f"WITH {_GRADE} SELECT conv_id, turn, score FROM gs")
def grade_answers(spark, sf):
    return _grades(spark, sf)


@query(f"WITH {_GRADE} SELECT conv_id, round(100 * avg(score), 1) AS score, count(*) FILTER (WHERE score >= 1) AS correct, count(*) AS total FROM gs GROUP BY conv_id")
def attempt_scores(spark, sf):
    return _grades(spark, sf).groupBy("conv_id").agg(F.round(100 * F.avg("score"), 1).alias("score"), F.count_if(F.col("score") >= 1).alias("correct"), F.count(F.lit(1)).alias("total"))


@query(r"""WITH a AS (SELECT doc_id, text || ' [1, 3][3] [' || (doc_id % 7)::VARCHAR || ']' AS answer FROM documents),
    n AS (SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:[ ]*,[ ]*\d+)*)\]', 1), lambda x: string_split(x, ','))), lambda x: trim(x)::INT) AS n FROM a)
    SELECT doc_id, array_to_string(list_filter(list_transform(range(1, 6), lambda i: i), lambda i: list_contains(n, i)), ',') AS cited FROM n""")
def citations(spark, sf):
    answer = F.concat("text", F.lit(" [1, 3][3] ["), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(study.citations(answer, F.lit(5))).cast("array<string>"), ",").alias("cited"))


_SM2 = f"""r AS (SELECT user_id, event_id % 5 AS card, ts, CASE event_type WHEN 'error' THEN 'again' WHEN 'view' THEN 'hard' WHEN 'click' THEN 'good' ELSE 'easy' END AS rating FROM events),
    h AS (SELECT *, row_number() OVER (PARTITION BY user_id, card ORDER BY ts, rating) AS n, CASE rating WHEN 'again' THEN 4 WHEN 'hard' THEN 2 WHEN 'good' THEN 1 ELSE 0 END AS gap FROM r),
    f AS (SELECT 0::BIGINT AS n, user_id, card, 2.5::DOUBLE AS ease, 0.0::DOUBLE AS interval_days, 0 AS repetitions, 0 AS lapses, NULL::TIMESTAMP AS ts, '' AS rating FROM (SELECT DISTINCT user_id, card FROM h) UNION ALL
        SELECT h.n, h.user_id, h.card, e, CASE WHEN h.rating = 'again' THEN 0.0 WHEN f.repetitions = 0 THEN CASE h.rating WHEN 'easy' THEN 4.0 ELSE 1.0 END WHEN f.repetitions = 1 THEN CASE h.rating WHEN 'hard' THEN 3.0 WHEN 'good' THEN 6.0 ELSE 8.0 END
            ELSE floor(greatest(f.interval_days, 1.0::DOUBLE) * CASE h.rating WHEN 'hard' THEN 1.2::DOUBLE WHEN 'good' THEN e ELSE e * 1.3::DOUBLE END * 10 + 0.5::DOUBLE) / 10.0::DOUBLE END::DOUBLE,
            CASE WHEN h.rating = 'again' THEN 0 ELSE f.repetitions + 1 END, f.lapses + (h.rating = 'again')::INT, h.ts, h.rating
        FROM f JOIN h ON h.user_id = f.user_id AND h.card = f.card AND h.n = f.n + 1, LATERAL (SELECT greatest(1.3::DOUBLE, floor((f.ease + 0.1::DOUBLE - h.gap * (0.08::DOUBLE + h.gap * 0.02::DOUBLE)) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE) AS e)),
    cards AS (SELECT user_id, card, ease, interval_days, repetitions, lapses, n::INT AS reviews, ts AS last_reviewed_at,
        epoch_us(ts) / 1e6::DOUBLE + CASE WHEN rating = 'again' THEN 600.0::DOUBLE ELSE interval_days * 86400.0::DOUBLE END AS due_at FROM f WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id, card ORDER BY n DESC) = 1)"""


def _cards(spark, sf):
    rating = F.when(F.col("event_type") == "error", "again").when(F.col("event_type") == "view", "hard").when(F.col("event_type") == "click", "good").otherwise("easy")
    reviews = table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("card"), F.date_trunc("microsecond", "ts").alias("ts"), rating.alias("rating"))
    return study.fold_reviews(reviews, ["user_id", "card"])


@query(f"WITH RECURSIVE {_SM2} SELECT user_id, card, ease, interval_days, repetitions, lapses, reviews, epoch_us(last_reviewed_at) AS last_us, due_at FROM cards")
def sm2_fold(spark, sf):
    return _cards(spark, sf).select("user_id", "card", "ease", "interval_days", "repetitions", "lapses", "reviews", F.unix_micros(F.col("last_reviewed_at").cast("timestamp")).alias("last_us"), "due_at")


def _next(rating: str) -> str:
    gap = {"again": 4, "hard": 2, "good": 1, "easy": 0}[rating]
    if rating == "again":
        return "10 / 1440.0::DOUBLE"
    first, second = {"hard": (1, 3), "good": (1, 6), "easy": (4, 8)}[rating]
    e = f"greatest(1.3::DOUBLE, floor((ease + 0.1::DOUBLE - {gap} * (0.08::DOUBLE + {gap} * 0.02::DOUBLE)) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE)"
    factor = {"hard": "1.2::DOUBLE", "good": e, "easy": f"{e} * 1.3::DOUBLE"}[rating]
    return f"CASE repetitions WHEN 0 THEN {first} WHEN 1 THEN {second} ELSE floor(greatest(interval_days, 1.0::DOUBLE) * ({factor}) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE END::DOUBLE"


@query(f"WITH RECURSIVE {_SM2} SELECT user_id, card, {', '.join(f'{_next(r)} AS {r}' for r in study.QUALITY)} FROM cards")
def interval_preview(spark, sf):
    return _cards(spark, sf).select("user_id", "card", *[study.next_interval(r).alias(r) for r in study.QUALITY])


@query(f"WITH RECURSIVE {_SM2}, n AS (SELECT max(epoch_us(ts)) / 1e6::DOUBLE AS now FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY due_at, card) AS position, card, due_at FROM cards, n WHERE due_at <= now QUALIFY position <= 3")
def due_queue(spark, sf):
    now = table(spark, sf, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("now"))
    # The clock is one row.
    return study.due_queue(_cards(spark, sf).join(F.broadcast(now)), "user_id", "card", 3).select("user_id", "position", "card", "due_at")


@query(f"WITH RECURSIVE {_SM2}, n AS (SELECT max(epoch_us(ts)) / 1e6::DOUBLE AS now FROM events) SELECT user_id, count(*) AS cards, count(*) FILTER (WHERE due_at <= now) AS due, count(*) FILTER (WHERE reviews > 1) AS reviewed FROM cards, n GROUP BY user_id")
def deck_summary(spark, sf):
    now = table(spark, sf, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("now"))
    return study.deck_summary(_cards(spark, sf).join(F.broadcast(now)), "user_id", F.col("reviews") > 1)


@query(f"""WITH {_GRADE}, t AS (SELECT conv_id, turn, ['short_answer', 'true_false', 'mcq'][turn % 3 + 1] AS kind, trim(text) AS given, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations),
    m AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(b, lambda x: list_contains(a, x)))) AS matched, len(b) AS size, score FROM gs)
    SELECT t.conv_id, t.turn, kind, CASE WHEN given = '' AND kind <> 'true_false' THEN 0.0 WHEN kind = 'short_answer' THEN score WHEN kind = 'true_false' THEN [1.0, 0.0, 1.0, 0.0, 0.0, 1.0][conv_id % 6 + 1] * (turn % 2) + [0.0, 1.0, 0.0, 1.0, 0.0, 0.0][conv_id % 6 + 1] * (1 - turn % 2) ELSE (lower(given) = lower(reference))::INT END::DOUBLE AS score,
        CASE WHEN given = '' AND kind <> 'true_false' THEN 'No answer given.' WHEN kind <> 'short_answer' OR size = 0 THEN '' ELSE 'Matched ' || len(matched) || ' of ' || size || ' key terms' || CASE WHEN len(matched) > 0 THEN ': ' || array_to_string(matched[:8], ', ') ELSE '' END END AS feedback
    FROM t JOIN m USING (conv_id, turn)""")
def graded_items(spark, sf):
    from pyspark.sql import Window

    said = table(spark, sf, "conversations").withColumn("reference", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("reference is not null")
    kind = F.element_at(F.array(*map(F.lit, ("short_answer", "true_false", "mcq"))), (F.col("turn") % 3 + 1).cast("int"))
    # Statements are right in odd turns; what is said about them goes by the conversation.
    tried = F.element_at(F.array(*map(F.lit, ("True", "f", " YES.", "no", "maybe", "\u6b63\u786e"))), (F.col("conv_id") % 6 + 1).cast("int"))
    marked = F.col("kind") == "true_false"
    said = said.withColumn("kind", kind).withColumn("text", F.when(marked, tried).otherwise(F.col("text"))).withColumn("reference", F.when(marked, F.when(F.col("turn") % 2 == 1, "True").otherwise("False")).otherwise(F.col("reference")))
    return said.select("conv_id", "turn", "kind", study.grade(F.col("kind"), F.col("text"), F.col("reference")).alias("g")).select("conv_id", "turn", "kind", "g.score", "g.feedback")


@query(r"""SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[\t\r\n]+', ' ', 'g')) || chr(9) || trim(regexp_replace(text, '[\t\r\n]+', ' ', 'g')) || chr(9) || source AS line FROM documents""")
def anki_export(spark, sf):
    return table(spark, sf, "documents").select("doc_id", deck_line(F.substring_index("text", "\n", 1), F.col("text"), F.col("source")).alias("line"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0)")
def cascade_delete(spark, sf):
    # Customers in debt are removed, and with them their orders and lines.
    kept = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = tables.cascade(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey")
    return tables.cascade(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, c_nationkey AS owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def owned_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    chain = [(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "o_orderkey", "c_custkey"), (table(spark, sf, "customer"), "c_custkey", "c_nationkey")]
    return tables.owner_of(lines, chain, "owner").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "owner")


@query("SELECT user_id, event_type, event_id AS latest FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_valid_token(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("latest"))


@query("SELECT source, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (source, quality))")
def status_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.groupingSets([["source"], ["source", "quality"]], "source", "quality").agg(F.count(F.lit(1)).alias("n"))
