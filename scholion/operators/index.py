"""The state of a chunk index: stale and empty scopes, and an even sample of a scope's chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_readiness(docs: DataFrame, scope: str, signature: Column, current: Column, chunks: Column) -> DataFrame:
    """(scope, ready, stale, error): documents with chunks, those of them indexed under another signature (a missing
    one counts), and why the scope cannot be searched."""
    by = docs.groupBy(scope).agg(F.count_if(chunks > 0).alias("ready"), F.count_if((chunks > 0) & ~signature.eqNullSafe(current)).alias("stale"))
    return by.withColumn("error", F.when(F.col("ready") == 0, "no_materials").when(F.col("stale") > 0, "stale_index"))


#: Offsets of a sample are this many parts of a step.
PARTS = 1 << 20


def study_sample(chunks: DataFrame, scope: str, limit: int, long_chars: int = 200, most_chars: int | None = None, seed: int | None = None) -> DataFrame:
    """(scope, position, doc_id, chunk_index): up to ``limit`` chunks of each scope, spread evenly over its
    documents and over each document, documents in turn.

    Chunks (scope, doc_id, chunk_index, char_count) of ``long_chars`` or more are preferred where a document has any. A
    document's quota is the limit over the scope's documents, rounded up. With a ``seed`` each document begins at an offset of its own, hashed from
    seed, scope and id. With ``most_chars`` a chunk that does not fit into what is left of the scope's budget is passed over and the next ones are
    tried; the first fits always. Which chunks of a document are taken follows from its own numbers alone, so those windows hold one document;
    each task cuts a scope to what can be taken before the scope's rows meet.
    """
    doc = Window.partitionBy(scope, "doc_id")
    usable = chunks.withColumn("_long", F.col("char_count") >= long_chars).withColumn("_any", F.max("_long").over(doc)).filter(F.col("_long") | ~F.col("_any"))
    numbered = usable.withColumn("_i", (F.row_number().over(doc.orderBy("chunk_index")) - 1).cast("long")).withColumn("_c", F.count(F.lit(1)).over(doc))
    quota = chunks.groupBy(scope).agg(F.count_distinct("doc_id").alias("_d")).select(F.col(scope).alias("_scope"), F.ceil(F.lit(limit) / F.col("_d")).alias("_q"))
    placed = numbered.join(quota, F.col(scope).eqNullSafe(F.col("_scope"))).withColumn("_q", F.least("_q", "_c"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(scope).cast("string"), F.col("doc_id").cast("string")))
    placed = placed.withColumn("_h", F.lit(0).cast("long") if seed is None else F.conv(F.substring(digest, 1, 5), 16, 10).cast("long"))
    # Turn t takes chunk floor((t + h / PARTS) * c / q): chunk i is taken if the first turn that gets as far as it gives i.
    ahead = F.col("_i") * F.col("_q") * PARTS - F.col("_h") * F.col("_c")
    placed = placed.withColumn("_ahead", ahead).withColumn("_t", F.when(F.col("_ahead") <= 0, F.lit(0).cast("long")).otherwise(F.expr(f"(_ahead + _c * {PARTS} - 1) div (_c * {PARTS})")))
    picked = placed.filter((F.col("_t") < F.col("_q")) & (F.expr(f"((_h + _t * {PARTS}) * _c) div (_q * {PARTS})") == F.col("_i")))
    if most_chars is not None:
        return _in_budget(picked, scope, limit, most_chars)
    position = F.row_number().over(Window.partitionBy(scope).orderBy("_t", "doc_id"))
    return picked.withColumn("position", position.cast("long")).filter(F.col("position") <= limit).select(scope, "position", "doc_id", "chunk_index")


def _in_budget(picked: DataFrame, scope: str, limit: int, most: int) -> DataFrame:
    """The greedy choice within a budget. A chunk is chosen only if all earlier ones that are as short were, so of each length the first ``limit``
    of a scope are all that can be chosen, and a scope is folded over no more rows than that."""
    length = Window.partitionBy(scope, "char_count").orderBy("_t", "doc_id")
    first = picked.withColumn("_r", F.row_number().over(length)).filter(F.col("_r") <= limit)
    kinds = dict(picked.dtypes)

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_t", "ascending"), ("doc_id", "ascending")])
        taken, total = [], 0
        for n, chars in enumerate(rows["char_count"].to_pylist()):
            if len(taken) == limit:
                break
            if not taken or total + chars <= most:
                taken.append(n)
                total += chars
        out = rows.take(pa.array(taken, pa.int64()))
        return pa.table({scope: out[scope], "position": pa.array(range(1, len(taken) + 1), pa.int64()), "doc_id": out["doc_id"], "chunk_index": out["chunk_index"]})

    rows = first.select(scope, "doc_id", "chunk_index", "char_count", "_t")
    return rows.groupBy(scope).applyInArrow(fold, f"{scope} {kinds[scope]}, position long, doc_id {kinds['doc_id']}, chunk_index {kinds['chunk_index']}")
