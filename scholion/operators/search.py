"""Search of many queries at once: BM25 postings, dense and sparse cosine, rank fusion, result rows, metrics."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.batches import bounded_batches, slices
from scholion.functions.text import tokens, truncate
from scholion.functions.words import KANA, keyword_tokens, stem_word
from scholion.sources.scratch import spread, stored

#: Up to so many rows a query table is sent to every task; beyond, it is dealt by term.
BROADCAST_ROWS = 100_000
#: Up to so many different query terms are looked up where a text is split; beyond, by a join.
LOOKED_UP = 20_000
#: Query vectors that meet all texts in one pass (8 bytes for each of their dimensions), and cells of a block of scores.
QUERY_ROWS, CELLS = 10_000, 1 << 22
#: Rows of a bucket of dense vectors, and the least of a block of them; numbers of a block, and scores that are looked at together.
BLOCK_ROWS, BLOCK_CELLS, SCORES = 2_000, 1 << 21, 1 << 21
#: The most hyperplanes of a table: with more, tables and so the copies of a vector would grow with the number of vectors.
PLANES = 3
#: Texts whose words a task counts, when they are dealt by word.
DEALT_TEXTS = 10_000
#: Words of texts that a task has in Python at once, a text at least, and rows of vectors that it makes dense.
WORDS, DENSE_ROWS = 1 << 17, 512


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table of short rows that is small: its size is checked, never assumed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, len, n_terms): one row for each term of a document. A narrow job but for the
    count by document and term; lengths are computed before the explode, without a second pass."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_t"))
    words = words.select("doc_id", "_t", F.size("_t").cast("long").alias("len"), F.size(F.array_distinct("_t")).cast("long").alias("n_terms"))
    words = words.select("doc_id", "len", "n_terms", F.explode("_t").alias("term"))
    return words.groupBy("doc_id", "term", "len", "n_terms").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def occurrences(found: DataFrame, key: str, texts: int) -> DataFrame:
    """(key, n): how often each value stands in ``found``, which comes from so many ``texts``. Where most values are rare, counting in the task
    that reads them saves little and its table grows with the file, so they are dealt first, to more tasks the more texts there are."""
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts // DEALT_TEXTS))
    return found.repartition(parts, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _stemmed(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Pieces of batches with a bounded number of words, and the stems of each of their texts; a word is stemmed once in a
    piece, and its stem is one string there."""
    for part in (part for batch in batches for part in slices(batch, column, WORDS)):
        lists = part.column(column)
        codes = lists.flatten().dictionary_encode()
        stems = [stem_word(w) for w in codes.dictionary.to_pylist()]
        words = list(map(stems.__getitem__, codes.indices.to_numpy().tolist()))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
        yield part, [words[start:end] for start, end in pairwise([0, *ends])]


def _pairs(words: list[str]) -> list[str]:
    return [a + b for a, b in pairwise(words) if a >= KANA and b >= KANA] if words and max(words) >= KANA else []


def _counted(docs: DataFrame, wanted: set[str] | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, len, n_terms, terms, tfs): of each text the number of its terms and of its distinct ones, and the counts of
    those ``wanted`` (None: all)."""
    bounded_batches(docs.sparkSession)
    kinds = ", ".join(f"{k} {dict(docs.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _stemmed(batches, len(keys)):
            sizes, distinct, terms, tfs = [], [], [], []
            for words in texts:
                counts = Counter(words)
                counts.update(_pairs(words))
                sizes.append(sum(counts.values()))
                distinct.append(len(counts))
                kept = counts if wanted is None else {t: counts[t] for t in counts.keys() & wanted}
                terms.append(list(kept))
                tfs.append(list(kept.values()))
            yield pa.record_batch([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(distinct, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], [*keys, "len", "n_terms", "terms", "tfs"])

    return spread(docs.select(*keys, "text")).select(*keys, tokens(F.col("text")).alias("_t")).mapInArrow(run, f"{kinds}, len long, n_terms long, terms array<string>, tfs array<long>")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, distinct_len: bool = False, k1: float = 1.5, b: float = 0.75, pool: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) for ``queries`` (query_id, query), over stems and pairs of CJK characters. Query
    terms count once; the length is the terms of a text, or its distinct ones. With a ``pool``, only the so many texts that hold a query's
    terms most often (ties to the smaller id) are ranked for it; statistics are those of all texts.

    Texts are read once: what is kept of each is a row with its lengths and its counts of query terms, made where the text
    is read; document frequencies, means and scores come from there."""
    terms = queries.select("query_id", F.explode(F.array_distinct(keyword_tokens(F.col("query")))).alias("term"))
    wanted = [r["term"] for r in terms.select("term").distinct().limit(LOOKED_UP + 1).collect()]
    read = stored(_counted(docs, set(wanted) if len(wanted) <= LOOKED_UP else None), "postings")
    hits = read.select("doc_id", "len", "n_terms", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", "len", "n_terms", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    if len(wanted) > LOOKED_UP:
        hits = hits.join(terms.select("term").distinct(), "term", "left_semi")
    stats = read.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), F.avg("n_terms").alias("avg_terms"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length, mean = ("n_terms", "avg_terms") if distinct_len else ("len", "avg_len")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col(length) / F.col(mean)))
    # The statistics are one row.
    scored = hits.join(df, "term").join(sized(terms), "term").join(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.sum("tf").alias("_held"))
    if pool is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_held"), "doc_id"))
        scored = scored.withColumn("_place", place).filter(F.col("_place") <= pool)
    return top_k(scored.filter("score > 0"), k)


def top_k(scored: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.asc("doc_id")])))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def embed(docs: DataFrame, dim: int = 384, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, dims, weights): signed feature hashing of stems, their pairs and the pairs of CJK characters, weight
    1 + ln(tf), unit length; a text without features has no row. All of a text's features are counted where it is read."""
    kind = dict(docs.dtypes)[id_col]
    return _words(docs, id_col, text).mapInArrow(lambda batches: _embedded(batches, dim), f"id {kind}, dims array<int>, weights array<double>")


def _words(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text"))).select("id", tokens(F.col("_text")).alias("_t"))


def _embedded(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in _stemmed(batches, 1):
        ids, dims, weights = [], [], []
        for n, words in enumerate(texts):
            counts = Counter([*words, *_pairs(words), *(f"{a}_{b}" for a, b in pairwise(words))])
            # Of a feature's digest the first four bytes give its place, the next half byte its sign.
            digests = np.frombuffer(b"".join([hashlib.md5(f.encode()).digest() for f in counts]), np.uint8).reshape(-1, 16)
            at = digests[:, :4].copy().view(">u4").ravel() % dim
            tfs = np.fromiter(counts.values(), float, len(counts))
            w = np.bincount(at, np.where(digests[:, 4] < 128, 1.0, -1.0) * (1 + np.log(tfs)), dim)
            length = np.sqrt((w * w).sum())
            if length > 0:
                ids.append(n)
                dims.append(np.unique(at).astype(np.int32))
                weights.append(w[dims[-1]] / length)
        yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(dims, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["id", "dims", "weights"])


def hash_embed(docs: DataFrame, dim: int = 384, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``embed`` as sparse rows (id, dim, weight)."""
    return embed(docs, dim, id_col, text).select("id", F.explode(F.arrays_zip("dims", "weights")).alias("x")).select("id", F.col("x.dims").cast("long").alias("dim"), F.col("x.weights").alias("weight"))


def densify(sparse: DataFrame, dim: int = 384) -> DataFrame:
    """(id, embedding): rows of ``embed`` as arrays of ``dim`` doubles."""
    at = F.map_from_arrays("dims", "weights")
    return sparse.withColumn("_m", at).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("embedding"))


def wrong_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has another dimension, or none."""
    return vectors.filter(F.coalesce(F.size(vector), F.lit(-1)) != dim)


def vector_text(vector: Column) -> Column:
    """A vector as ``[x,y,...]`` with six decimals; ``vector_of`` reads it."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def vector_of(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\] ]", ""), ","), lambda x: x.cast("double"))


def signature(provider: str, model: str, dim: int) -> str:
    """What vectors must have in common to be compared."""
    return f"{provider}:{model}:{dim}"


def sparse_cosine(chunks: DataFrame, queries: DataFrame, k: int = 5, dim: int = 384) -> DataFrame:
    """(query_id, rank, doc_id, score): the k nearest rows of ``chunks`` to each of ``queries``, both as ``embed`` gives
    them. Query vectors are packed into matrices of a bounded number of rows, each of which meets all texts in one pass; a
    task keeps the k best for each of them, so that nothing else is shuffled."""
    queries, blocks = _query_blocks(queries)
    chunks = stored(chunks, "vectors") if len(blocks) > 1 else chunks
    return _best_of([_nearest(chunks, block, k, dim) for block in blocks], k)


def text_cosine(docs: DataFrame, queries: DataFrame, k: int = 5, dim: int = 384, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``sparse_cosine`` of the texts of ``docs``: a text becomes a vector and meets the queries in the same Python worker, so that
    vectors are not kept. Beyond one matrix of queries they are, and computed once."""
    queries, blocks = _query_blocks(queries)
    if len(blocks) > 1:
        return sparse_cosine(embed(docs, dim, id_col, text), queries, k, dim)
    return _best_of([_nearest(_words(docs, id_col, text), blocks[0], k, dim, lambda batches: _embedded(batches, dim))], k)


def _query_blocks(queries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Query vectors, computed once, and in parts of some ``QUERY_ROWS``."""
    queries = stored(queries, "query-vectors")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    return queries, [queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n) for n in range(blocks)]


def _best_of(parts: list[DataFrame], k: int) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_k(found, k)


def _nearest(chunks: DataFrame, queries: DataFrame, k: int, dim: int, embedded=None) -> DataFrame:
    bounded_batches(chunks.sparkSession)
    asked = queries.select("id", "dims", "weights").toArrow()
    ids = asked.column("id").to_numpy()
    matrix = _dense(asked.column("dims"), asked.column("weights"), dim).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        rows = max(64, min(DENSE_ROWS, CELLS // max(1, len(ids))))
        given = embedded(batches) if embedded else batches
        for part in (batch.slice(at, rows) for batch in given for at in range(0, batch.num_rows, rows)):
            own = part.column(0).to_numpy()
            scores = np.round(_dense(part.column(1), part.column(2), dim) @ matrix, 6) + 0.0
            # Only what is as good as the last of a query's k can be among them.
            least = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best])
            for n in np.flatnonzero((scores >= least).any(0)).tolist():
                new = np.flatnonzero(scores[:, n] >= least[n])
                s, i = np.concatenate([best[n][0], scores[new, n]]), np.concatenate([best[n][1], own[new]])
                order = np.lexsort((i, -s))[:k]
                best[n] = s[order], i[order]
        if len(ids):
            yield pa.record_batch({"query_id": np.repeat(ids, [len(s) for s, _ in best]), "doc_id": np.concatenate([i for _, i in best]), "score": np.concatenate([s for s, _ in best])})

    return chunks.withColumn("id", F.col("id").cast("long")).mapInArrow(run, "query_id long, doc_id long, score double")


def _dense(dims: pa.Array | pa.ChunkedArray, weights: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    dims, weights = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (dims, weights))
    out = np.zeros((len(dims), dim))
    sizes = np.diff(dims.offsets.to_numpy())
    out[np.repeat(np.arange(len(dims)), sizes), dims.flatten().to_numpy()] = weights.flatten().to_numpy()
    return out


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, dim): vectors that have a direction."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"  # floats travel as such
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _block_nearest(k: int, own: bool = False):
    """For each query of a block (id, v) the k nearest of another one, without or with its ``own`` row."""

    def nearest(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not (asked.num_rows and given.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = [t["id"].to_numpy() for t in (asked, given)]
        units = []
        for t in (asked, given):
            m = t["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(t.num_rows, -1)
            m = m / np.abs(m).max(1, keepdims=True)
            units.append(m / np.sqrt((m * m).sum(1, keepdims=True)))
        out: list[list] = [[], [], []]
        some = max(1, SCORES // given.num_rows)
        for n, scores in enumerate(row for at in range(0, asked.num_rows, some) for row in np.round(units[0][at : at + some] @ units[1].T, 6)):
            other = np.arange(len(ids[1])) if own else np.flatnonzero(ids[1] != ids[0][n])
            if len(other) > k:
                at = np.partition(scores[other], len(other) - k)[len(other) - k]
                other = other[scores[other] >= at]
            best = other[np.lexsort((ids[1][other], -scores[other]))][:k]
            out[0].append(np.full(len(best), ids[0][n]))
            out[1].append(ids[1][best])
            out[2].append(scores[best] + 0.0)
        return pa.table({name: np.concatenate(c) for name, c in zip(("query_id", "doc_id", "score"), out, strict=True)})

    return nearest


def dense_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k nearest of ``vectors`` to each of ``queries`` by cosine, exactly. A vector
    is not its own neighbour (by id). Blocks of rows meet in pairs, and k rows a query leave a pair; blocks are as large as a
    task's memory allows, as a row is sent once for each block of the other side, but enough for all cores. Vectors are compared where their dimensions are equal; null, zero or not finite ones, and null ids, are left out."""
    side = int(np.ceil(np.sqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism)))

    def blocks(df: DataFrame) -> int:
        rows, dim = df.agg(F.count(F.lit(1)), F.max("dim")).first()
        if block_rows:
            return max(1, -(-rows // block_rows))
        return max(1, -(-rows // max(BLOCK_ROWS, BLOCK_CELLS // (dim or 1))), min(side, -(-rows // BLOCK_ROWS)))

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        return df.withColumn(names[0], mine).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left, right = _usable(queries, id_col, vector), _usable(vectors, id_col, vector)
    a, b = blocks(left), blocks(right)
    keys = ["dim", "qb", "vb"]
    pairs = dealt(left, a, b, ("qb", "vb")).groupBy(*keys).cogroup(dealt(right, b, a, ("vb", "qb")).groupBy(*keys))
    return top_k(pairs.applyInArrow(_block_nearest(k), "query_id long, doc_id long, score double"), k)


def lsh_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", bucket: int = BLOCK_ROWS, similarity: float = 0.5, recall: float = 0.98, seed: int = 13) -> DataFrame:
    """(query_id, rank, doc_id, score): near rows of ``vectors`` to each of ``queries`` by cosine, found approximately and ranked exactly.

    Tables of random hyperplanes: a vector's bucket is which sides it is on, with as many planes as make buckets of ``bucket``
    rows, ``PLANES`` at most, and as many tables as find a neighbour of ``similarity`` with the probability ``recall``; nearer ones are found more
    often. A query meets the vectors of its buckets, block by block, and nothing else. Equal vectors, however many, are one
    vector here, which stands for the k + 1 smallest of their ids: no ranking can show more. A bucket that is larger than asked is cut into
    blocks. Vectors are compared where their dimensions are equal; null, zero or not finite ones, and null ids, are left out."""
    rows = _usable(vectors, id_col, vector)
    once = rows.groupBy("v", "dim").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    once = stored(once.select(F.col("_first").alias("id"), "v", "dim", "_n"), "distinct-vectors")
    sizes = once.groupBy("dim").count().collect()  # a row for each dimension
    planes = {d: min(PLANES, max(1, int(np.ceil(np.log2(max(2, n / bucket)))))) for d, n in sizes}
    p = 1 - np.arccos(similarity) / np.pi
    tables = {d: max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p**b)))) for d, b in planes.items()}

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, v, dim) once for each table, with the table and the bucket in it."""
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                if d not in planes:
                    continue
                m = own.column(1).flatten().to_numpy().astype(float).reshape(own.num_rows, d)
                rng = np.random.default_rng((seed, d))
                for t in range(tables[d]):
                    side = (m @ rng.normal(size=(d, planes[d])) > 0) @ (1 << np.arange(planes[d], dtype=np.int64))
                    yield pa.record_batch([*own.columns, np.full(own.num_rows, t, np.int32), side], ["id", "v", "dim", "t", "h"])

    kinds = f"id long, v {dict(once.dtypes)['v']}, dim int, t int, h long"
    places = lambda batches: (b.select(["dim", "t", "h"]) for b in buckets(batches))
    given = once.select("id", "v", "dim").mapInArrow(buckets, kinds)  # made again where it is needed, rather than kept in all its copies
    blocks = once.select("id", "v", "dim").mapInArrow(places, "dim int, t int, h long").groupBy("dim", "t", "h").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(2 * bucket))).alias("_blocks"))
    blocks = blocks.select(F.col("dim").alias("_d"), F.col("t").alias("_t"), F.col("h").alias("_h"), "_blocks")
    blocks = sized(stored(blocks, "bucket-sizes"))
    same = (F.col("dim") == F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col("h") == F.col("_h"))
    keys = ["dim", "t", "h", "block"]
    cut = given.join(blocks, same).withColumn("block", F.pmod(F.xxhash64("id"), "_blocks")).select("id", "v", *keys)
    asked = _usable(queries, id_col, vector)
    asked = asked.mapInArrow(buckets, f"id long, v {dict(asked.dtypes)['v']}, dim int, t int, h long")
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20))  # queries of a bucket are cut, too, with a copy of its blocks
    ways = asked.groupBy("dim", "t", "h").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(2 * bucket))).alias("_ways")).select(F.col("dim").alias("_d"), F.col("t").alias("_t"), F.col("h").alias("_h"), "_ways")
    ways = sized(stored(ways, "query-counts"))
    asked = asked.join(blocks, same).drop("_d", "_t", "_h").join(ways, same).withColumn("way", F.pmod(part, "_ways")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cut = cut.join(ways, same).withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ways") - 1)))
    keys = [*keys, "way"]
    pairs = asked.select("id", "v", *keys).groupBy(*keys).cogroup(cut.select("id", "v", *keys).groupBy(*keys))
    # A query's own vector may stand for others, so it is looked at with k more.
    found = pairs.applyInArrow(_block_nearest(k + 1, own=True), "query_id long, doc_id long, score double").distinct()
    several = rows.join(once.filter("_n > 1").select(F.col("v").alias("_v"), F.xxhash64("v").alias("_x"), F.col("id").alias("_first")), (F.xxhash64("v") == F.col("_x")) & (F.col("v") == F.col("_v")))
    place = F.row_number().over(Window.partitionBy("_first", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))
    some = several.select("_first", "id").distinct().withColumn("_p", place).filter(F.col("_p") <= k + 1)
    some = some.withColumn("_p", F.row_number().over(Window.partitionBy("_first").orderBy("id"))).filter(F.col("_p") <= k + 1).select("_first", F.col("id").alias("_other"))
    found = top_k(found, k + 1).join(some, F.col("doc_id") == F.col("_first"), "left").withColumn("doc_id", F.coalesce("_other", "doc_id"))
    return top_k(found.filter("query_id <> doc_id").select("query_id", "doc_id", "score"), k)


def fuse(rankings: DataFrame, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, source, doc_id, rank); ties by vector rank, keyword rank, id."""
    by = rankings.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.when(F.col("source") == "vector", F.col("rank"))).alias("_v"), F.min(F.when(F.col("source") == "keyword", F.col("rank"))).alias("_k")
    )
    return top_k(by, k, [F.desc("score"), F.asc_nulls_last("_v"), F.asc_nulls_last("_k"), F.asc("doc_id")])


def hit_texts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``hits`` name by doc_id; the texts of others stay where they are read."""
    return docs.join(sized(hits.select("doc_id").distinct()), "doc_id", "left_semi")


def result_rows(hits: DataFrame, docs: DataFrame, scores: DataFrame, limit: int = 320, decimals: int = 4) -> DataFrame:
    """(query_id, index, doc_id, attributes of ``docs``, snippet, score, vector_score, keyword_score): ranked ids as rows
    to show. Only documents that were hit are looked at; ``scores`` are the rankings (query_id, source, doc_id, score)."""
    raw = scores.groupBy("query_id", "doc_id").agg(*[F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"{s}_score") for s in ("vector", "keyword")])
    found = hits.join(raw, ["query_id", "doc_id"], "left")
    named = hit_texts(docs, hits).withColumn("snippet", truncate(F.col("text"), limit)).drop("text")
    rounded = [(F.floor(F.col(c) * 10**decimals + 0.5) / 10**decimals).alias(c) for c in ("score", "vector_score", "keyword_score")]
    return found.join(named, "doc_id").select("query_id", F.col("rank").alias("index"), *named.columns, *rounded)


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents in which a passage (query_id, query) stands whole. A passage's words but its first and last one
    stand in such a text as words of their own, so a passage is looked for in the documents that have the rarest of them; one
    without such words, in all documents. Empty passages are in none."""
    asked = passages.filter("query <> ''").select("query_id", "query", tokens(F.col("query")).alias("_t"))
    inner = asked.filter(F.size("_t") > 2).select("query_id", F.explode(F.array_distinct(F.slice("_t", 2, F.size("_t") - 2))).alias("term"))
    terms = stored(inner, "passage-terms")
    posts = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(sized(terms.select("term").distinct()), "term", "left_semi")
    posts = stored(posts, "passage-postings")
    counts = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = terms.join(counts, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("b")).select("query_id", "b.term")
    near = stored(posts.join(sized(rarest), "term").select("query_id", "doc_id").distinct(), "passage-candidates")
    texts = docs.select("doc_id", "text")
    found = near.join(hit_texts(texts, near), "doc_id").join(sized(asked.select("query_id", "query")), "query_id").filter(F.contains("text", "query")).select("query_id", "doc_id")
    short = asked.filter(F.size("_t") <= 2).select("query_id", "query")
    return found.unionByName(texts.join(sized(short), F.contains("text", "query")).select("query_id", "doc_id")).distinct()


def abstention(best: DataFrame, answerable: DataFrame, threshold: float) -> DataFrame:
    """(answerable, n, flagged): how often the best score (0 without any) falls below the threshold, for questions that can
    be answered (false alarms) and those that cannot."""
    asked = answerable.join(best, "query_id", "left").withColumn("_low", (F.coalesce("best_score", F.lit(0.0)) < threshold).cast("double"))
    return asked.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_low"), 6).alias("flagged"))


def metrics(ranks: DataFrame) -> DataFrame:
    """Recall@1, 3, 5 and mean reciprocal rank of (mode, category, rank, null for a miss), by mode and by mode and category."""
    recall = [F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6).alias(f"recall_{n}") for n in (1, 3, 5)]
    sums = [F.count(F.lit(1)).alias("n"), *recall, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    return ranks.groupBy("mode").agg(*sums).withColumn("category", F.lit("all")).unionByName(ranks.groupBy("mode", "category").agg(*sums))


#: Providers of embeddings by name: functions from texts (id, text columns) to (id, dims, weights).
PROVIDERS = {"hash": embed}


def embedding_provider(name: str):
    """The provider of a name; others can be put into ``PROVIDERS``."""
    if name not in PROVIDERS:
        raise ValueError(f"no embedding provider {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def context(questions: DataFrame, docs: DataFrame, sample: DataFrame, count: int) -> DataFrame:
    """(query_id, rank, doc_id): what to generate from. Questions with a topic (query) get what they find, the others the
    even sample of their scope (scope, position, doc_id); max(6, min(count + 4, 14)) of either."""
    limit = max(6, min(count + 4, 14))
    found = bm25(docs, questions.filter("query is not null").select("query_id", "query"), limit).select("query_id", "rank", "doc_id")
    spread = questions.filter("query is null").join(sample, "scope").filter(F.col("position") <= limit)
    return found.unionByName(spread.select("query_id", F.col("position").alias("rank"), "doc_id"))
