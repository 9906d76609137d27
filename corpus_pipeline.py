"""The corpus pipeline: language ID, exact and near deduplication, mixing, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from scholion.llm.common import ascii_lower, table, written

#: Up to so many ids (16 MB) are sent to the scan that filters by them; beyond, documents are dealt by id.
BROADCAST_IDS = 2_000_000


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (column _keep); a null id matches a null."""
    ids = written(ids.distinct(), "kept")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs["doc_id"].eqNullSafe(ids["_keep"]), "left_semi")


def _repeated(docs: DataFrame) -> DataFrame | None:
    """The ids (column _keep) that several rows of ``docs`` have; None if there are none."""
    ids = written(docs.groupBy(F.col("doc_id").alias("_keep")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_keep"), "repeated")
    return None if ids.isEmpty() else ids


def _by_row(docs: DataFrame, kept: DataFrame, sha: Column, once: bool) -> DataFrame:
    """``docs`` whose id and text digest ``sha`` are among ``kept`` (columns _keep, _sha). With ``once``, of the rows
    that have an id and a digest in common the one with the smallest text and other columns stays."""
    kept = kept.distinct()
    # A row travels as one column, so that no name of its columns meets those used here.
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_i"), F.col("text").alias("_t"), sha.alias("_s"))
    found = marked.join(kept, F.col("_i").eqNullSafe(F.col("_keep")) & (F.col("_s") == F.col("_sha")), "left_semi")
    if once:
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("_i", "_s").orderBy("_t", "_row"))).filter("_r = 1")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _split(docs: DataFrame, ids: DataFrame, repeated: DataFrame, kept: DataFrame, sha: Column, once: bool) -> DataFrame:
    """Rows of an id of their own stay by id, those that share one by what was decided on the row itself."""
    several = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_keep"]), "left_semi")
    single = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_keep"]), "left_anti")
    return _only(single, ids).unionByName(_by_row(several, kept, sha, once))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without any letter, or without text, go. Each row goes by its own text,
    where it is read: nothing is joined."""
    told = langid.identify(docs, keep=docs.columns)
    return told.filter(F.col(langid.answers(docs.columns)[0]) != "und").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; once, if it is repeated."""
    found = exact_dedup.exact_dedup(docs).filter("kept")
    ids = found.select(F.col("doc_id").alias("_keep"))
    repeated = _repeated(docs)
    if repeated is None:
        return _only(docs, ids)
    return _split(docs, ids, repeated, found.select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha")), F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256), True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id. A repeated id is one document of several
    texts, each of which stays once."""
    linked = jaccard_join.near_duplicates(docs)
    ids = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep"))
    repeated = _repeated(docs)
    if repeated is None:
        return _only(docs, ids)
    ids = written(ids.distinct(), "kept")
    kept = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_keep"]), "left_semi").select(F.col("doc_id").alias("_keep"), _digest(F.col("text")).alias("_sha"))
    return _split(docs, ids, repeated, kept, _digest(F.col("text")), True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes) of each document; the ids' bytes are decoded again and counted."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: Language ID, near deduplication and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
