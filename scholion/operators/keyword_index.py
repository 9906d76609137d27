"""A keyword index that is built once, kept current, and read by any number of batches of queries.

``postings`` (term, doc_id, part, tf) are in buckets by term, one set of folders for each change; ``documents`` (doc_id,
scope, part, len, n_terms) say which part holds a document's current postings, so a document that is replaced costs its own
postings and its bucket of ``documents``. A query reads the buckets of its terms, no text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.words import keyword_tokens
from scholion.operators.search import _counted, sized, top_k
from scholion.sources.scratch import stored
from scholion.sources.snapshots import Snapshots

TERM_BUCKETS = 64
#: Tasks that write the postings of a bucket.
DOC_PARTS = 16


def _term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS))


def index_documents(spark: SparkSession, path: str, docs: DataFrame, removed: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> int:
    """Puts ``docs`` (doc_id, scope, text, and section if there is one) in the index at ``path`` in place of what it has under their ids, and
    takes those ``removed`` (doc_id) out. Gives the index's version; a batch of a stream that went in already changes nothing. A
    repeated id gives one document, of its greatest text."""
    index = Snapshots(spark, path)
    before = index.manifest()
    if stream is not None and before["batches"].get(stream, -1) >= batch:
        return before["version"]
    text = F.concat_ws(" ", F.col("section"), F.col("text")) if "section" in docs.columns else F.coalesce(F.col("text"), F.lit(""))
    once = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(text.alias("text"), F.col("scope"))).alias("d")).select("doc_id", "d.scope", "d.text")
    return index.commit(before, keyword_tables(index, before, once, removed), stream, batch)


def keyword_tables(index: Snapshots, before: dict, docs: DataFrame, removed: DataFrame | None = None) -> dict:
    """The two tables with ``docs`` (doc_id, scope, text; an id once) and without those ``removed``, as ``commit`` takes them."""
    part = uuid.uuid4().hex
    counted = stored(_counted(docs, None, ("doc_id", "scope")).withColumn("part", F.lit(part)), "counted")
    terms = counted.select("doc_id", "part", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), "doc_id", "part", F.col("x.tfs").alias("tf"))
    documents = counted.select("doc_id", "scope", "part", "len", "n_terms")
    gone = documents.select("doc_id") if removed is None else documents.select("doc_id").unionByName(removed.select("doc_id"))
    tables = index.written(before, "documents", documents, gone, "doc_id")
    return tables | index.appended(before, "postings", terms, _term_bucket(F.col("term")), F.pmod(F.xxhash64("doc_id"), F.lit(DOC_PARTS)))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, scoped: bool = True, distinct_len: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score) for ``queries`` (query_id, query, and scope if ``scoped``), over one version of the index.

    A query looks only at the documents of its scope, or, if ``allowed`` (query_id, doc_id) names some for it, at those among them; the number of documents,
    their mean length and the document frequencies are those of what it looks at. A null scope is a scope. Nothing is
    gathered by scope: statistics and frequencies are sums, and rankings are by query."""
    index = Snapshots(spark, path)
    manifest = index.manifest()
    documents = index.read("documents", manifest).select("doc_id", "part", "len", "n_terms", *([F.struct("scope").alias("_scope")] if scoped else [F.struct(F.lit(0).alias("scope")).alias("_scope")]))
    asked = queries.select("query_id", F.struct("scope").alias("_asked") if scoped else F.struct(F.lit(0).alias("scope")).alias("_asked"), "query")
    terms = stored(asked.select("query_id", "_asked", F.explode(F.array_distinct(keyword_tokens(F.col("query")))).alias("term")), "query-terms")
    buckets = {str(r[0]) for r in terms.select(_term_bucket(F.col("term"))).distinct().collect()}  # TERM_BUCKETS at most
    posts = index.read("postings", manifest, buckets).join(sized(terms.select("term").distinct()), "term", "left_semi")
    hits = stored(posts.join(documents, ["doc_id", "part"]), "hits")
    length = "n_terms" if distinct_len else "len"
    sums = [F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("mean")]

    def scored(found: DataFrame, stats: DataFrame, key: str) -> DataFrame:
        """Scores of (key, query_id, term, doc_id, tf, length) where key says what is looked at together."""
        df = found.select(key, "term", "doc_id").distinct().groupBy(key, "term").agg(F.count(F.lit(1)).alias("df")) if key == "_scope" else found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col(length) / F.col("mean")))
        rows = found.join(sized(df), [key, "term"]).join(sized(stats), key)
        return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    free = terms if allowed is None else terms.join(allowed.select("query_id").distinct(), "query_id", "left_anti")
    own = hits.join(sized(free.withColumnRenamed("_asked", "_scope")), ["_scope", "term"])
    found = scored(own.select("_scope", "query_id", "term", "doc_id", "tf", length), documents.groupBy("_scope").agg(*sums), "_scope")
    if allowed is not None:
        seen = allowed.select("query_id", "doc_id").distinct().join(asked.select("query_id", F.col("_asked").alias("_scope")), "query_id").join(documents, ["doc_id", "_scope"])
        seen = stored(seen.select("query_id", "doc_id", length), "allowed")
        rows = hits.select("term", "doc_id", "tf").join(seen, "doc_id").join(terms.select("query_id", "term"), ["query_id", "term"])
        found = found.unionByName(scored(rows, seen.groupBy("query_id").agg(*sums), "query_id"))
    return top_k(found.filter("score > 0"), k)
