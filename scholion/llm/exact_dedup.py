"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut where its content says so: at the first sentence or line end after 256 characters,
at 2,048 characters at the latest. Chunks become identifiers; a document becomes the ordered list of its
chunk identifiers, its *recipe*; documents are equal when their recipes are. Long documents are
therefore never compared, sorted or joined as text: their text crosses the network once, as distinct
chunks that are combined before the shuffle, and from then on only lists of integers move.

An identifier is *verified*: it starts as a 64-bit hash, the chunks themselves are grouped under
their hash, and where two different chunks share a hash each gets an ordinal that becomes part of the
identifier. Equality is therefore that of bytes and does not rest on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import ascii_lower, written

#: A chunk ends after a sentence or line end, when it has 256 characters; it never exceeds 2,048.
CHUNK = r"(?s).{256,2047}?(?:[.!?]\s|\n)|.{1,2048}"


def chunks_of(text: Column) -> Column:
    """The content-defined chunks of a text, in order; concatenated they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row for each row of ``df``: (id, keep_id, group_size, kept, text_sha256, n_chunks).

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest
    id stays (``keep_id``). A null text counts as empty, and all empty texts are equal. Rows that
    repeat an id are rows like any other: each counts in ``group_size``, and all rows with the
    staying id are ``kept``. A null id never wins against another id; a group that has only null ids
    has a null ``keep_id`` and is kept. Other columns of ``df`` are not read. ``hash_bits`` shortens
    the hashes, so that tests can see clashes resolved.
    """
    mask = (1 << hash_bits) - 1 if hash_bits < 64 else -1
    base = df.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    hashed = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))
    recipes = written(
        base.select("_id", F.transform(chunks_of(F.col("_text")), hashed).alias("_recipe"), F.sha2("_text", 256).alias("_sha")),
        "recipes",
    )
    chunks = base.select(F.explode(chunks_of(F.col("_text"))).alias("_chunk")).select(hashed(F.col("_chunk")).alias("_h"), "_chunk").distinct()
    clashes = written(chunks.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "clashes")
    if not clashes.isEmpty():
        recipes = _with_ordinals(recipes, base, chunks, clashes, hashed)
    recipes = recipes.withColumn("_rid", F.xxhash64("_recipe"))
    groups = recipes.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("_recipe").alias("_r"), F.xxhash64("_recipe").alias("_g"), "keep_id", "group_size")
    # Joined on hash and list: both sides are dealt anew for the join, so that Spark can split the
    # partition of a recipe that a large part of all documents share.
    return recipes.join(groups, (F.col("_rid") == F.col("_g")) & (F.col("_recipe") == F.col("_r"))).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.size("_recipe").cast("long").alias("n_chunks"),
    )


def _with_ordinals(recipes: DataFrame, base: DataFrame, chunks: DataFrame, clashes: DataFrame, hashed) -> DataFrame:
    """Recipes in which each chunk with a clashing hash also has its ordinal among the chunks of that hash.

    Only the chunks that share a hash with a different chunk pass through the window; recipes are put
    together again by text digest, so the rows of ``base`` need no key of their own.
    """
    named = (
        chunks.join(clashes, "_h", "left_semi")
        .withColumn("_ord", F.row_number().over(Window.partitionBy("_h").orderBy("_chunk")).cast("long"))
    )
    parts = (
        base.select(F.sha2("_text", 256).alias("_sha"), "_text")
        .dropDuplicates(["_text"])
        .select("_sha", F.xxhash64("_text", F.lit(1)).alias("_key"), F.posexplode(chunks_of(F.col("_text"))).alias("_pos", "_chunk"))
        .withColumn("_h", hashed(F.col("_chunk")))
        .join(named, ["_h", "_chunk"], "left")
    )
    lists = parts.groupBy("_sha", "_key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_h", F.coalesce("_ord", F.lit(0)).alias("_ord")))), lambda s: F.array(s["_h"], s["_ord"]))).alias("_full")
    )
    lists = written(lists, "ordinals")
    keyed = base.select("_id", F.sha2("_text", 256).alias("_sha"), F.xxhash64("_text", F.lit(1)).alias("_key"))
    return written(
        keyed.join(lists, ["_sha", "_key"], "left").select("_id", F.coalesce("_full", F.array().cast("array<bigint>")).alias("_recipe"), "_sha"),
        "recipes",
    )
